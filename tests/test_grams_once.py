"""Pairs that meet on several grams are told apart where they stand."""

from pyspark.sql import functions as F

from tastegraph.functions.text import trigram_similarity
from tastegraph.plans.grams import similar_texts


def test_each_pair_once_without_gathering(spark):
    words = ["hot bolt", "hot bolts", "cold bolt", "bolt hot hot", "old gear", "older gears", "gear", "anvil", "anvils", "an anvil"]
    left = spark.createDataFrame([(w,) for w in words], "l_text string")
    right = spark.createDataFrame([(w + s,) for w in words for s in ("", " ring")], "r_text string")
    met = similar_texts(left, right, 0.3)
    every = left.crossJoin(right).withColumn("sim", trigram_similarity(F.col("l_text"), F.col("r_text"))).filter("sim >= 0.3")
    rows = lambda df: sorted((r.l_text, r.r_text, round(r.sim, 6)) for r in df.select("l_text", "r_text", "sim").collect())
    assert rows(met) == rows(every) and len(rows(every)) > 20
    plan = met._jdf.queryExecution().analyzed().toString().splitlines()
    assert not [line for line in plan if "Deduplicate" in line and "l_text" in line]
