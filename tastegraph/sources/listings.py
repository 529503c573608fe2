"""Ranked provider listings as landed tables: union, discovery rails, search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, today
from tastegraph.operators.views import top_rows

# Discovery windows and vote floors.
NEW_DAYS = 90
HORIZON_DAYS = 365
VOTE_FLOOR = {"movie": 25, "show": 15}


def kind_of(media_type: Column) -> Column:
    """The provider's media type as a kind."""
    return F.when(media_type == "tv", "show").when(media_type == "movie", "movie")


def union_listings(listings: list[DataFrame]) -> DataFrame:
    """The distinct (kind, provider_id) of several listings with their best position."""
    rows = reduce(DataFrame.unionByName, [d.select("media_type", "provider_id", "position") for d in listings])
    return rows.withColumn("kind", kind_of(F.col("media_type"))).filter(F.col("kind").isNotNull()).groupBy(
        "kind", "provider_id").agg(F.min("position").alias("position"))


def _items(listing: DataFrame) -> DataFrame:
    usable = (F.coalesce("title", F.lit("")) != "") & F.col("poster_path").isNotNull()
    return listing.withColumn("kind", kind_of(F.col("media_type"))).filter(F.col("kind").isNotNull() & usable)


def new_releases(listing: DataFrame, as_of: AsOf, limit: int = 12) -> DataFrame:
    """Released in the last ninety days with enough votes, most popular first."""
    day = today(as_of)
    floor = F.when(F.col("kind") == "movie", VOTE_FLOOR["movie"]).otherwise(VOTE_FLOOR["show"])
    recent = F.col("release_date").between(F.date_sub(day, NEW_DAYS), day)
    rows = _items(listing).filter(recent & (F.col("vote_count") >= floor))
    return rows.orderBy(F.desc("popularity"), "kind", "provider_id").limit(limit).select(
        "kind", "provider_id", "title", "release_date", "popularity")


def upcoming(listing: DataFrame, as_of: AsOf, limit: int = 12) -> DataFrame:
    """Out within a year from tomorrow, soonest first."""
    day = today(as_of)
    ahead = (F.col("release_date") > day) & (F.col("release_date") <= F.date_add(day, HORIZON_DAYS))
    return _items(listing).filter(ahead).orderBy("release_date", F.desc("popularity"), "kind", "provider_id").limit(limit).select(
        "kind", "provider_id", "title", "release_date", "popularity")


def trending(listing: DataFrame, limit: int = 18) -> DataFrame:
    """The listing in its own order without people and untitled or posterless items."""
    return _items(listing).orderBy("position", "kind", "provider_id").limit(limit).select(
        "kind", "provider_id", "title", "position")


def shape_provider_results(results: DataFrame, limit: int = 12) -> DataFrame:
    """Provider search results per query: titles only, most popular first."""
    rows = results.withColumn("kind", kind_of(F.col("media_type"))).filter(F.col("kind").isNotNull()).select(
        "query_id", "kind", "provider_id", F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.year("release_date").alias("year"), "poster_path", F.coalesce("popularity", F.lit(0.0)).alias("popularity"))
    return top_rows(rows, ["query_id"], [F.col("popularity").desc(), F.col("kind"), F.col("provider_id")], limit)
