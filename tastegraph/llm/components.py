"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.plans.lineage import checkpoint


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node each linked node can reach, for nodes with a link to another node.

    Each round lets every node point its larger, then its smaller, neighbours at the smallest it knows. Minima are
    pre-aggregated and joined back, so a node with many links is never gathered. Rounds end when nothing changes,
    after about the logarithm of the longest chain. NULL ends and links of a node to itself are ignored.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = checkpoint(e), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (before is not None and tuple(now) == before):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
