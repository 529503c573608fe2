"""Themes derived from keywords by a crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.operators.views import top_rows
from tastegraph.tables import Tables

# Salience below which a theme is noise, and themes kept per title.
SALIENCE_THRESHOLD = 0.5
THEMES_PER_TITLE = 6


def derive_themes(title_keyword: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Theme edges (title_id, concept_id, salience): the strongest themes by summed salience."""
    mapped = crosswalk.filter(F.col("concept_id").isNotNull()).select(
        F.lower("keyword_label").alias("k"), "concept_id", "salience")
    scored = (
        title_keyword.select("title_id", F.lower("keyword_label").alias("k")).join(mapped, "k")
        .groupBy("title_id", "concept_id").agg(F.sum(F.col("salience").cast("double")).alias("score"))
    )
    best = top_rows(scored, ["title_id"], [F.round("score", 6).desc(), F.col("concept_id")], THEMES_PER_TITLE)
    return best.filter(F.round("score", 6) >= SALIENCE_THRESHOLD).select(
        "title_id", "concept_id", F.least("score", F.lit(1.0)).alias("salience"))


def theme_coverage(t: Tables) -> DataFrame:
    """How much of the corpus the crosswalk covers, as one row of counts."""
    keyworded = t.title_keyword.select(F.col("title_id").alias("id")).distinct().withColumn("has_kw", F.lit(True))
    themed = t.edge.filter(F.col("predicate") == "explores_theme").select(
        F.col("subject_id").alias("id")).distinct().withColumn("themed", F.lit(True))
    flags = t.title.select("id").join(keyworded, "id", "left").join(themed, "id", "left").select(
        F.coalesce("has_kw", F.lit(False)).alias("has_kw"), F.coalesce("themed", F.lit(False)).alias("themed"))
    titles = flags.agg(
        F.count("*").alias("titles"), F.count_if(~F.col("has_kw")).alias("no_keywords"),
        F.count_if("has_kw").alias("with_keywords"), F.count_if(F.col("has_kw") & F.col("themed")).alias("themed"))
    decided = t.crosswalk.groupBy(F.lower("keyword_label").alias("k")).agg(
        F.bool_or(F.col("concept_id").isNotNull()).alias("mapped"), F.bool_or(F.col("concept_id").isNull()).alias("excluded"))
    kw = t.title_keyword.select("title_id", F.lower("keyword_label").alias("k"))
    # keywords first per label, then per assignment: neither needs a distinct over the other's rows
    per_label = kw.groupBy("k").agg(F.count("*").alias("n")).join(decided, "k", "left")
    pairs = kw.distinct().groupBy("k").agg(F.count("*").alias("pairs"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    keywords = per_label.join(pairs, "k").agg(
        F.count("*").alias("distinct_keywords"), F.count_if(flag("mapped")).alias("mapped_keywords"),
        F.count_if(flag("excluded")).alias("excluded_keywords"), F.coalesce(F.sum("n"), F.lit(0)).alias("assignments"),
        F.coalesce(F.sum(F.when(flag("mapped"), F.col("pairs"))), F.lit(0)).alias("mapped_assignments"),
        F.coalesce(F.sum(F.when(flag("excluded"), F.col("pairs"))), F.lit(0)).alias("excluded_assignments"))
    # two single rows side by side
    return titles.withColumn("one", F.lit(1)).join(keywords.withColumn("one", F.lit(1)), "one").drop("one")
