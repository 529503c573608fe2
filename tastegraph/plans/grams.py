"""Text matching as equi joins on letter grams.

Equal texts are collapsed before anything is joined, so a group of copies counts once, and texts meet
only on grams that are rare enough to be in their prefix: no pair is formed that shares only common
pieces, and none that reaches the threshold is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.text import trigram_overlap, trigrams


def prefix_grams(texts: DataFrame, text: str, frequency: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``texts`` with ``grams``, ``prefix`` and one row per gram of their prefix.

    Two gram sets whose shared share is at least t share a gram among the first
    |A| - ceil(t |A|) + 1 of each, when both are ordered the same way; here rare grams come first.
    """
    grams = texts.withColumn("grams", trigrams(F.col(text)))
    keys = texts.columns
    ranked = (
        grams.select(*keys, "grams", F.explode("grams").alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy(*keys, "grams")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("by_rarity"))
    )
    size = F.size("grams")
    length = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
    return ranked.withColumn("prefix", F.slice("by_rarity", F.lit(1), length)["gram"]).select(
        *keys, "grams", "prefix", F.explode("prefix").alias("gram"))


def gram_frequency(texts: DataFrame, text: str) -> DataFrame:
    """In how many texts each gram occurs."""
    return texts.select(F.explode(trigrams(F.col(text))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, block: list[str] | None = None,
                  where: Column | None = None) -> DataFrame:
    """Pairs (left columns, right columns, ``sim``) of similar texts.

    ``left`` has a text column ``l_text`` and ``right`` ``r_text``; both hold distinct rows. ``block``
    names columns both sides must agree on; ``where`` is a further condition on a pair.
    """
    block = block or []
    frequency = gram_frequency(right.select("r_text").distinct(), "r_text")
    l = prefix_grams(left, "l_text", frequency, threshold).withColumnsRenamed({"grams": "l_grams", "prefix": "l_prefix"})
    r = prefix_grams(right, "r_text", frequency, threshold).withColumnsRenamed({"grams": "r_grams", "prefix": "r_prefix"})
    a, b = F.size("l_grams"), F.size("r_grams")
    met = l.join(r, ["gram", *block]).filter((a >= threshold * b - 1e-9) & (b >= threshold * a - 1e-9))
    if where is not None:
        met = met.filter(where)
    kept = [c for c in left.columns + right.columns if c not in block]
    # a pair that meets on several grams is kept at one of them, where it stands: nothing is gathered to tell its copies apart
    pairs = met.filter(F.col("gram") == F.array_min(F.array_intersect("l_prefix", "r_prefix"))).drop("gram", "l_prefix", "r_prefix")
    sim = trigram_overlap(F.col("l_text"), F.col("r_text"), F.col("l_grams"), F.col("r_grams"))
    return pairs.withColumn("sim", sim).filter(F.col("sim") >= threshold).select(*block, *kept, "sim")


def _pieces(col: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(col) - (n - 1))
    return F.when(F.length(col) >= n, F.transform(starts, lambda i: F.substring(col, i, F.lit(n))))


def pieces_of(col: Column) -> Column:
    """The distinct runs of two and of three letters."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(_pieces(col, 2), none), F.coalesce(_pieces(col, 3), none)))


def containing_texts(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle, text) where the text contains the needle, for needles of two letters or more.

    A needle meets only the texts that hold its rarest piece, which is then checked in full.
    """
    needles, texts = needles.select("needle").distinct(), texts.select("text").distinct()
    pieces = texts.select("text", F.explode(pieces_of(F.col("text"))).alias("piece"))
    frequency = pieces.groupBy("piece").agg(F.count("*").alias("df"))
    own = F.when(F.length("needle") == 2, F.array("needle")).otherwise(_pieces(F.col("needle"), 3))
    rarest = (
        needles.select("needle", F.explode(F.array_distinct(own)).alias("piece"))
        .join(frequency, "piece").groupBy("needle").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"))
    )
    return pieces.join(rarest, "piece").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")
