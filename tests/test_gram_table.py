"""A stored gram table finds what a search without one finds, is added to, and is not shuffled."""

import contextlib
import io
import os
import time

from pyspark.sql import functions as F

from tastegraph.operators import search as Q
from tastegraph.plans.gramtable import containing_stored, gram_table, similar_stored


def asked(t):
    words = t.title.select(F.col("id").alias("query_id"), F.col("title").alias("query")).orderBy("query_id").limit(60)
    return words.withColumn("query", F.when(F.col("query_id") % 3 == 0, F.substring("query", 2, 5)).when(F.col("query_id") % 3 == 1, F.concat(F.col("query"), F.lit(" x"))).otherwise(F.col("query")))


def found(df):
    return sorted((r["query_id"], r["id"], r["rn"], round(r["sim"], 6)) for r in df.collect())


def test_stored_grams_find_the_same(spark, t, tmp_path):
    queries, path = asked(t), str(tmp_path / "grams")
    want = found(Q.search_titles(queries, t.title))
    half = t.title.filter("id % 2 = 0")
    Q.title_grams(half, "half_titles", path)
    assert found(Q.search_titles(queries, half, table=gram_table(spark, "half_titles"))) == found(Q.search_titles(queries, half))
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    Q.title_grams(t.title, "half_titles", path)  # the other half; those that are there stay as they are
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    table = gram_table(spark, "half_titles")
    assert before.items() <= after.items() and table.grams.count() == table.grams.distinct().count()
    start = time.time()
    assert found(Q.search_titles(queries, t.title, table=table)) == want and want
    assert time.time() - start < 60
    # the tables are read bucket by bucket: no exchange lies between a join and their scan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan, name in ((similar_stored(queries.select(F.lower("query").alias("l_text")), table, 0.3), "half_titles_grams"),
                           (containing_stored(queries.select(F.lower("query").alias("needle")), table), "half_titles_pieces")):
            with contextlib.redirect_stdout(io.StringIO()) as told:
                plan.explain()
            lines = told.getvalue().split("\n")
            depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
            scans = [i for i, line in enumerate(lines) if "FileScan" in line and name in line]
            assert scans
            for i in scans:
                above, at = [], depth(lines[i])
                for line in reversed(lines[:i]):
                    if depth(line) < at:
                        above.append(line)
                        at = depth(line)
                        if "Join" in line:
                            break
                assert not any("Exchange" in line for line in above), lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
