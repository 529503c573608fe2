"""A stored table of texts by their letter grams, which searches read without shuffling it.

Two bucketed tables hold each distinct text once under every gram: ``<name>_grams`` (3-grams of similar texts) and ``<name>_pieces`` (2- and 3-letter
pieces of texts that may contain a needle). Both lie bucketed by gram, so a search deals its own few grams to the buckets and the tables stay
where they are; frequencies are counted bucket by bucket. New texts are appended under their grams; nothing is rewritten.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.functions.text import trigram_overlap, trigrams
from tastegraph.plans.grams import pieces_of, prefix_grams


class GramTable(NamedTuple):
    """The stored texts: for likeness and for containment."""

    grams: DataFrame
    pieces: DataFrame


def _append(rows: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    rows.repartition(buckets, key).write.mode("append").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def _new(texts: DataFrame, spark: SparkSession, table: str) -> DataFrame:
    new = texts.filter("text is not null").distinct()
    return new.join(spark.table(table).select("text").distinct(), "text", "left_anti") if spark.catalog.tableExists(table) else new


def add_texts(likened: DataFrame, contained: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Add texts to the tables ``name``, made on first use with their files at ``path``: those searched by likeness and those searched by containment.

    Texts that are there already are left out, so adding the same again changes nothing. ``buckets`` must stay what it was.
    """
    spark = likened.sparkSession
    near = _new(likened.select("text"), spark, f"{name}_grams").withColumn("grams", trigrams(F.col("text")))
    _append(near.select(F.explode("grams").alias("gram"), "text", F.size("grams").alias("size")), f"{name}_grams", f"{path}/grams", "gram", buckets)
    inside = _new(contained.select("text"), spark, f"{name}_pieces")
    _append(inside.select(F.explode(pieces_of(F.col("text"))).alias("piece"), "text"), f"{name}_pieces", f"{path}/pieces", "piece", buckets)


def gram_table(spark: SparkSession, name: str) -> GramTable:
    """The stored tables of a name."""
    return GramTable(spark.table(f"{name}_grams"), spark.table(f"{name}_pieces"))


def similar_stored(left: DataFrame, table: GramTable, threshold: float) -> DataFrame:
    """(l_text, r_text, sim): stored texts similar to each distinct ``l_text``, like ``similar_texts``.

    A text meets the stored ones on its own rarest grams only: if a pair shares a share t of grams, one of the first |A| - ceil(t |A|) + 1 is shared.
    """
    frequency = table.grams.groupBy("gram").agg(F.count("*").alias("df"))
    asked = prefix_grams(left.select("l_text").distinct(), "l_text", frequency, threshold).withColumnRenamed("grams", "l_grams")
    a, b = F.size("l_grams"), F.col("size")
    met = asked.join(table.grams, "gram").filter((a >= threshold * b - 1e-9) & (b >= threshold * a - 1e-9))
    pairs = met.select("l_text", F.col("text").alias("r_text")).distinct()
    sim = trigram_overlap(F.col("l_text"), F.col("r_text"), trigrams(F.col("l_text")), trigrams(F.col("r_text")))
    return pairs.withColumn("sim", sim).filter(F.col("sim") >= threshold)


def containing_stored(needles: DataFrame, table: GramTable) -> DataFrame:
    """(needle, text): stored texts that contain each needle of two letters or more, looked for under its rarest piece."""
    frequency = table.pieces.groupBy("piece").agg(F.count("*").alias("df"))
    asked = needles.select("needle").distinct()
    longest = F.when(F.length("needle") == 2, F.array("needle")).otherwise(F.filter(pieces_of(F.col("needle")), lambda p: F.length(p) == 3))
    # a needle with a piece that no text has is in none
    rarest = asked.select("needle", F.explode(longest).alias("piece")).join(frequency, "piece", "left").groupBy("needle").agg(
        F.min_by("piece", F.struct(F.coalesce("df", F.lit(0)), "piece")).alias("piece"))
    return rarest.join(table.pieces, "piece").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")
