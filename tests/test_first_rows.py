"""Which rows count: ends of the merged kind in the log of merges, the first line of those that repeat a number."""

from pyspark.sql import functions as F

from tastegraph.demo.catalog.ingest import season_payloads
from tastegraph.demo.model import AS_OF
from tastegraph.operators import merge as M
from tastegraph.sources import payloads as P
from tastegraph.tables import Tables

LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_linestatus string, l_shipdate timestamp"


def test_collapsed_edges_count_for_ends_of_the_merged_kind(spark, t):
    # concept 3 is no title, though title 3 is merged too
    rows = [(f"e{i}", "title", i, "belongs_to_genre", "concept", 3) for i in (1, 2)]
    edge = spark.createDataFrame(rows, "id string, subject_type string, subject_id long, predicate string, object_type string, object_id long")
    merges = spark.createDataFrame([(2, 1), (3, 1)], "merged_id long, surviving_id long")
    got = M.merge_log(t.replace(edge=edge), merges, AS_OF).select("merged_id", "collapsed").collect()
    assert {r.merged_id: r.collapsed for r in got} == {2: 1, 3: 0}


def test_first_line_of_a_number_is_its_episode(spark, tmp_path):
    when = F.lit("2001-02-03").cast("timestamp")
    lines = spark.range(0, 4000, 1, 1).select(
        (F.col("id") % 1000).alias("l_orderkey"), F.lit(7).cast("long").alias("l_partkey"), F.lit(1).alias("l_linenumber"),
        (4000 - F.col("id")).cast("double").alias("l_quantity"), F.lit("F").alias("l_linestatus"), when.alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lines"))
    part = spark.createDataFrame([(7, 30)], "p_partkey long, p_size int")
    tables = Tables(lineitem=spark.read.schema(LINE).parquet(str(tmp_path / "lines")).repartition(5, F.rand(1)), part=part)
    got = P.parse_season(season_payloads(tables)).select("episode_number", "runtime_minutes").collect()
    assert {r.episode_number: r.runtime_minutes for r in got} == {n: 4000 - n for n in range(1000)}
