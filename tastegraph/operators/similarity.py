"""Titles alike by the rare things they share: crew, themes, lead cast, franchise.

Every shared key adds ``ln(corpus / frequency)`` times a coefficient. Each title keeps its strongest
partners on either side of it in id order, so the result is at most two dozen rows per title, while a
key held by a third of all titles would pair them quadratically. Rare keys meet in blocks of titles, common ones under
score bounds (``plans/blockjoin.py``); pairs come out scored, with the reason their strongest signal gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import squash
from tastegraph.operators.views import top_rows
from tastegraph.plans.blockjoin import Judge, strongest_scored
from tastegraph.plans.lineage import written
from tastegraph.tables import Tables

# Weights of the shared signals and how many partners a title keeps.
CREW_WEIGHTS = {"directed": 1.6, "wrote": 1.1, "composed_for": 0.7, "shot": 0.7}
THEME_WEIGHT = 0.9
THEME_DEFAULT_SALIENCE = 0.5
LEAD_WEIGHT = 0.55
LEAD_BILLING = 2
FRANCHISE_SCORE = 4.0
PER_TITLE = 12
METHOD = "shared_signal_idf_v1"

SIGNALS = ("crew", "theme", "cast", "franchise")


def _title_credits(t: Tables, predicates: list[str]) -> DataFrame:
    return t.credit.filter(F.col("episode_id").isNull() & F.col("predicate").isin(predicates))


def _leads(t: Tables) -> DataFrame:
    return _title_credits(t, ["acted_in"]).filter(F.col("billing_order") <= LEAD_BILLING)


def _theme_edges(t: Tables) -> DataFrame:
    return t.edge.filter(F.col("predicate") == "explores_theme")


def signal_df(t: Tables) -> DataFrame:
    """Document frequency of every key per signal, beside the corpus size."""
    titles = lambda df, key: df.groupBy(F.col(key).alias("key_id")).agg(F.countDistinct("title_id").alias("df"))
    frames = [
        titles(_title_credits(t, list(CREW_WEIGHTS)), "person_id").select(F.lit("crew").alias("signal"), "key_id", "df"),
        _theme_edges(t).groupBy(F.col("object_id").alias("key_id")).agg(F.count("*").alias("df"))
        .select(F.lit("theme").alias("signal"), "key_id", "df"),
        titles(_leads(t), "person_id").select(F.lit("cast").alias("signal"), "key_id", "df"),
    ]
    corpus = t.title.agg(F.count("*").alias("n")).scalar()
    return reduce(DataFrame.unionByName, frames).withColumn("corpus", corpus)


def signal_features(t: Tables, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """What each title can share: (title_id, signal, role, key, weight, value).

    ``value`` is how often the title holds the key, or the salience of a theme.
    """
    idf = signal_df(t).select("signal", "key_id", F.log(F.col("corpus") / F.col("df")).alias("idf"))
    crew_weight = F.lit(0.0)
    for predicate, weight in CREW_WEIGHTS.items():
        crew_weight = F.when(F.col("role") == predicate, weight).otherwise(crew_weight)
    held = F.count("*").cast("double").alias("value")
    frames = []
    if "crew" in signals:
        crew = _title_credits(t, list(CREW_WEIGHTS)).groupBy(
            "title_id", F.col("person_id").alias("key_id"), F.col("predicate").alias("role")).agg(held)
        frames.append(crew.select("title_id", F.lit("crew").alias("signal"), "role", "key_id", crew_weight.alias("c"), "value"))
    if "theme" in signals:
        salience = F.coalesce(F.col("salience").cast("double"), F.lit(THEME_DEFAULT_SALIENCE))
        theme = _theme_edges(t).groupBy(F.col("subject_id").alias("title_id"), F.col("object_id").alias("key_id")).agg(F.min(salience).alias("value"))
        frames.append(theme.select("title_id", F.lit("theme").alias("signal"), F.lit("theme").alias("role"), "key_id",
                                   F.lit(THEME_WEIGHT).alias("c"), "value"))
    if "cast" in signals:
        cast = _leads(t).groupBy("title_id", F.col("person_id").alias("key_id")).agg(held)
        frames.append(cast.select("title_id", F.lit("cast").alias("signal"), F.lit("cast").alias("role"), "key_id",
                                  F.lit(LEAD_WEIGHT).alias("c"), "value"))
    weighted = [reduce(DataFrame.unionByName, frames).join(idf, ["signal", "key_id"]).withColumn("weight", F.col("c") * F.col("idf"))] if frames else []
    if "franchise" in signals:
        weighted.append(
            t.edge.filter(F.col("predicate") == "part_of_franchise").groupBy(
                F.col("subject_id").alias("title_id"), F.col("object_id").alias("key_id")).agg(held)
            .withColumns({"signal": F.lit("franchise"), "role": F.lit("franchise"), "weight": F.lit(FRANCHISE_SCORE)}))
    cols = ["title_id", "signal", "role", "weight", "value", F.concat_ws(":", "signal", "role", "key_id").alias("key")]
    return reduce(DataFrame.unionByName, [f.select(*cols) for f in weighted])


# The strongest signal of a pair gives its reason, crew by the weightiest shared craft.
MARKS = {"wrote": 1, "directed": 2}
REASONS = (("crew", "writer", "director"), ("theme",), ("cast",), ("franchise",))
JUDGE = Judge(REASONS, pooled=[SIGNALS.index("theme")], fixed={SIGNALS.index("franchise"): FRANCHISE_SCORE})


def _held(features: DataFrame) -> DataFrame:
    """The keys of each title as one array."""
    signal, mark = F.lit(None), F.lit(0)
    for place, name in enumerate(SIGNALS):
        signal = F.when(F.col("signal") == name, place).otherwise(signal)
    for role, worth in MARKS.items():
        mark = F.when(F.col("role") == role, worth).otherwise(mark)
    entry = F.struct(F.xxhash64("key").alias("key"), (F.col("signal") == "theme").alias("pooled"), "weight", "value", signal.alias("signal"), mark.alias("mark"))
    return features.groupBy(F.col("title_id").alias("id")).agg(F.collect_list(entry).alias("held"))


def scored_pairs(t: Tables, signals: tuple[str, ...] = SIGNALS, k: int = PER_TITLE) -> DataFrame:
    """Pairs (x, y, score, reason) that hold every title's k strongest partners on each side.

    A key of a title is scored as often as the title holds it; two or more shared themes count. Keys are told apart by 64-bit hashes.
    """
    return strongest_scored(written(_held(signal_features(t, signals))), k, JUDGE)


def rank_both_ends(combined: DataFrame, k: int = PER_TITLE) -> DataFrame:
    """Pairs among the k best of either end: partners after a title and before it are ranked apart."""
    ends = F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("title"), F.col("y").alias("partner")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("title"), F.col("x").alias("partner")))
    seen = combined.select("x", "y", "score", "reason", F.explode(ends).alias("e")).select("x", "y", "score", "reason", "e.*")
    kept = top_rows(seen, ["side", "title"], [F.col("score").desc(), F.col("partner")], k)
    return kept.select("x", "y", "score", "reason").distinct()


def strongest_pairs(t: Tables, signals: tuple[str, ...] = SIGNALS, k: int = PER_TITLE) -> DataFrame:
    """Each title's k strongest partners on either side over the given signals."""
    return scored_pairs(t, signals, k)


def crew_pairs(t: Tables, k: int = PER_TITLE) -> DataFrame:
    """Strongest partners by shared director, writer, composer, cinematographer."""
    return strongest_pairs(t, ("crew",), k)


def theme_pairs(t: Tables, k: int = PER_TITLE) -> DataFrame:
    """Strongest partners by two or more shared themes."""
    return strongest_pairs(t, ("theme",), k)


def lead_pairs(t: Tables, k: int = PER_TITLE) -> DataFrame:
    """Strongest partners by shared top-billed cast."""
    return strongest_pairs(t, ("cast",), k)


def franchise_pairs(t: Tables, k: int = PER_TITLE) -> DataFrame:
    """Partners in the same franchise."""
    return strongest_pairs(t, ("franchise",), k)


def combine_signals(t: Tables, signals: tuple[str, ...] = SIGNALS, k: int = PER_TITLE) -> DataFrame:
    """Pairs (x, y, score, reason) summed over whole signals, none of them cut before; the reason is that of the largest.

    Holds every title's k strongest partners on either side, so it is to be ranked by ``rank_both_ends``.
    """
    return scored_pairs(t, signals, k)


def similar_edges(kept: DataFrame) -> DataFrame:
    """Kept pairs as derived ``similar_to`` edges, scores squashed onto 0..1."""
    score = squash(F.col("score"))
    return kept.select(
        F.lit("title").alias("subject_type"), F.col("x").alias("subject_id"), F.lit("similar_to").alias("predicate"),
        F.lit("title").alias("object_type"), F.col("y").alias("object_id"), F.round(score, 4).alias("score"), "reason",
        F.round("score", 2).alias("raw_score"), F.round(score, 2).alias("confidence"), F.lit(METHOD).alias("method"))


def write_similar(kept: DataFrame, path: str) -> None:
    """Replace this method's derived edges and leave other methods' partitions alone."""
    similar_edges(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)
