"""What cannot be done right is refused, and rewrites leave the rest alone."""

import pytest
from pyspark.sql import functions as F

from tastegraph.operators import merge as M
from tastegraph.operators import similarity as S
from tastegraph.operators import taste as T


@pytest.mark.parametrize("n", [2, 3, 5])
def test_merge_cycles_are_refused(spark, n):
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(10, 11)], "merged_id long, surviving_id long")
    with pytest.raises(ValueError):
        M.close_merges(ring)


def test_long_merge_chains_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "merged_id long, surviving_id long")
    assert {tuple(r) for r in M.close_merges(chain).collect()} == {(i, 9) for i in range(9)}


def test_more_seeds_than_bits_are_refused(spark):
    meta = spark.createDataFrame([("acted_in", False, 1.0)], "predicate string, excluded_from_path_intermediates boolean, path_weight double")
    rows = [(1, "person", i, "acted_in", f"p{i}", 3, float(i)) for i in range(80)]
    affinity = spark.createDataFrame(rows, "account_id long, node_type string, node_id long, canonical_predicate string, label string, n_titles long, affinity_score double")
    with pytest.raises(ValueError):
        T.suggestion_seeds(affinity, meta, k=80)
    degree = spark.createDataFrame([("person", i, 2) for i in range(80)], "node_type string, node_id long, degree long")
    assert {r["bit"] for r in T.rank_seeds(T.suggestion_seeds(affinity, meta, k=62), degree).collect()} == set(range(62))
    seeds = affinity.withColumn("path_weight", F.lit(1.0))
    with pytest.raises(Exception, match="more than 62 seeds"):
        T.rank_seeds(seeds, degree).collect()


def test_similar_edges_are_replaced_by_method(spark, tmp_path):
    out = str(tmp_path / "similar")
    pairs = lambda *rows: spark.createDataFrame(rows, "x long, y long, score double, reason string")
    S.write_similar(pairs((1, 2, 3.0, "theme"), (1, 3, 2.0, "cast")), out)
    S.similar_edges(pairs((7, 8, 1.0, "crew"))).withColumn("method", F.lit("other")).write.mode("append").partitionBy("method").parquet(out)
    S.write_similar(pairs((1, 4, 5.0, "crew")), out)
    left = {(r["method"], r["subject_id"], r["object_id"]) for r in spark.read.parquet(out).collect()}
    assert left == {(S.METHOD, 1, 4), ("other", 7, 8)}
