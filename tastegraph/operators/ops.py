"""Operational analytics: queue health, freshness, counts, worklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import (
    RECENT_RELEASE_DAYS, AsOf, seconds_between, share_pct, timestamp, title_max_age, today,
)
from tastegraph.sources.ontology import ENTITY_TYPES
from tastegraph.tables import Tables

# How old the last success of a scheduled kind may be, stall line, failures that alarm.
MAX_AGE_S = {
    "refresh_degree": 172_800,
    "housekeeping": 172_800,
    "refresh_stale": 172_800,
    "refresh_availability": 172_800,
    "hydrate_people": 172_800,
}
FAILURES_ALARM = 3
STALE_BATCH = 60
HYDRATION_BATCH = 25
AVAILABILITY_BATCH = 30
AVAILABILITY_DAYS = 3


def _age(ts: Column, as_of: AsOf) -> Column:
    return F.floor(seconds_between(ts, timestamp(as_of)) + 0.5).cast("bigint")


def queue_summary(jobs: DataFrame, as_of: AsOf) -> DataFrame:
    """Depth, oldest waiting job and failures of the last day, in one pass."""
    queued = F.col("status") == "queued"
    recent = F.col("created_at") > timestamp(as_of) - F.expr("INTERVAL 24 HOURS")
    first = F.min(F.when(queued, F.struct("run_after", "id", "kind")))
    return jobs.agg(
        F.count_if(queued).alias("depth"), first.alias("first"),
        F.count_if((F.col("status") == "failed") & recent).alias("failed_24h"),
    ).select("depth", _age(F.col("first.run_after"), as_of).alias("oldest"), F.col("first.kind").alias("oldest_kind"), "failed_24h")


def queued_by_kind(jobs: DataFrame, as_of: AsOf) -> DataFrame:
    """Waiting jobs per kind and the age of the oldest."""
    return jobs.filter(F.col("status") == "queued").groupBy("kind").agg(
        _age(F.min("run_after"), as_of).alias("oldest"), F.count("*").alias("n"))


def kind_freshness(jobs: DataFrame, as_of: AsOf, limits: dict[str, int] | None = None) -> DataFrame:
    """Last success, its age and failures per kind, and what is wrong with it."""
    limits = MAX_AGE_S if limits is None else limits
    limit = F.lit(None).cast("bigint")
    for kind, seconds in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(seconds)).otherwise(limit)
    done = F.max(F.when(F.col("status") == "done", F.col("finished_at")))
    by_kind = jobs.groupBy("kind").agg(
        done.alias("last_success"), F.count_if(F.col("status") == "failed").alias("failures"))
    stale = F.coalesce(F.col("age_s") > limit, F.lit(False))
    return by_kind.withColumn("age_s", _age(F.col("last_success"), as_of)).select(
        "kind", "last_success", "age_s", "failures", stale.alias("is_stale"),
        (F.col("failures") >= FAILURES_ALARM).alias("is_failing"))


def corpus_freshness(title: DataFrame, as_of: AsOf) -> DataFrame:
    """Whole percent of titles whose record is younger than its allowed age."""
    age = title_max_age(F.col("kind"), F.col("status"), F.col("release_date"), as_of)
    fresh = seconds_between(F.col("synced_at"), timestamp(as_of)) < age * 86400
    return title.agg(F.count_if(fresh).alias("fresh"), F.count("*").alias("titles")).select(
        "titles", "fresh", share_pct(F.col("fresh"), F.col("titles")).alias("pct_fresh"))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")


def entity_counts(t: Tables) -> DataFrame:
    """Rows per entity table."""
    plain = {"people": "person", "credits": "credit", "edges": "edge", "derived_edges": "edge_derived", "concepts": "concept",
             "collections": "collection", "organizations": "organization", "works": "work", "characters": "character",
             "seasons": "season", "episodes": "episode"}
    frames = [_count(getattr(t, table), name) for name, table in plain.items()]
    frames.append(_count(t.person.filter(F.col("detail_synced_at").isNotNull()), "people_detailed"))
    return reduce(DataFrame.unionByName, frames)


def failure_diagnostics(jobs: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent errors."""
    return (
        jobs.filter(F.col("last_error").isNotNull())
        .groupBy("kind", "status", F.substring("last_error", 1, 500).alias("last_error"))
        .agg(F.max("attempts").alias("attempts"), F.count("*").alias("n"))
        .orderBy(F.desc("n"), "kind", "status", "last_error").limit(k)
    )


def predicate_use(edge: DataFrame) -> DataFrame:
    """Edges per predicate; at most one row per declared predicate."""
    return edge.groupBy("predicate").agg(F.count("*").alias("n"))


def graph_stats(t: Tables, edge: DataFrame) -> DataFrame:
    """The graph in numbers as (stat, value): counts, themed and resolved shares, top predicates."""
    themed = t.edge.filter(F.col("predicate") == "explores_theme").select(F.col("subject_id").alias("id")).distinct()
    flagged = t.title.join(themed.withColumn("themed", F.lit(True)), "id", "left").agg(
        F.count("*").alias("titles"), F.count_if("themed").alias("themed"))
    acted = t.credit.filter(F.col("predicate") == "acted_in").agg(
        F.count("*").alias("n"), F.count_if(F.col("character_id").isNotNull()).alias("resolved"))
    used = predicate_use(edge)
    stat = lambda df, name, value: df.select(F.lit(name).alias("stat"), value.cast("bigint").alias("value"))
    top = used.orderBy(F.desc("n"), "predicate").limit(8)
    frames = [
        stat(flagged, "titles", F.col("titles")),
        stat(flagged, "themed_pct", share_pct(F.col("themed"), F.col("titles"))),
        stat(t.person.agg(F.count("*").alias("n")), "people", F.col("n")),
        stat(used.agg(F.sum("n").alias("n")), "edges", F.col("n")),
        stat(used.agg(F.count("*").alias("n")), "predicates_in_use", F.col("n")),
        stat(t.predicate_meta.agg(F.count("*").alias("n")), "predicates_declared", F.col("n")),
        stat(t.concept.filter(F.col("scheme") == "theme").agg(F.count("*").alias("n")), "themes", F.col("n")),
        stat(acted, "characters_resolved_pct", share_pct(F.col("resolved"), F.col("n"))),
        stat(flagged, "node_types", F.lit(sum(e["graph_node"] for e in ENTITY_TYPES.values()))),
        top.select(F.concat(F.lit("top:"), "predicate").alias("stat"), F.col("n").alias("value")),
    ]
    return reduce(DataFrame.unionByName, frames)


def ontology_stats(t: Tables, edge: DataFrame, meta: DataFrame) -> DataFrame:
    """Entity and edge counts beside the declared and used vocabulary."""
    frames = [
        _count(t.title, "titles"), _count(t.person, "people"), _count(t.credit, "credits"),
        _count(t.edge.select("predicate").unionByName(t.edge_derived.select("predicate")), "edges"),
        _count(t.concept, "concepts"), _count(meta, "predicates"), _count(predicate_use(edge), "predicates_in_use"),
    ]
    return reduce(DataFrame.unionByName, frames)


def _tracked(t: Tables) -> DataFrame:
    return t.title_state.select(F.col("title_id").alias("id")).distinct().withColumn("tracked", F.lit(True))


def _provider_ids(t: Tables, entity_type: str, sources: list[str]) -> DataFrame:
    return t.external_id.filter((F.col("entity_type") == entity_type) & F.col("source").isin(sources)).select(
        F.col("entity_id").alias("id"), F.col("source_id").alias("provider_id"))


def stale_worklist(t: Tables, as_of: AsOf, k: int = STALE_BATCH) -> DataFrame:
    """Next titles to refresh: past half their allowed age; tracked, then recent, then oldest first."""
    now = timestamp(as_of)
    half = title_max_age(F.col("kind"), F.col("status"), F.col("release_date"), as_of) * 43200
    stale = t.title.filter(seconds_between(F.col("synced_at"), now) > half)
    recent = F.col("release_date").isNull() | (F.col("release_date") > F.date_sub(today(as_of), RECENT_RELEASE_DAYS))
    rows = stale.join(_provider_ids(t, "title", ["tmdb", "tmdb_tv"]), "id").join(_tracked(t), "id", "left").select(
        "id", "provider_id", "kind", F.coalesce("tracked", F.lit(False)).alias("tracked"), recent.alias("recent"), "synced_at")
    return rows.orderBy(F.desc("tracked"), F.desc("recent"), "synced_at", "id").limit(k)


def stale_remaining(t: Tables, as_of: AsOf) -> DataFrame:
    """How many titles are past half their allowed age."""
    half = title_max_age(F.col("kind"), F.col("status"), F.col("release_date"), as_of) * 43200
    return t.title.agg(F.count_if(seconds_between(F.col("synced_at"), timestamp(as_of)) > half).alias("n"))


def hydration_worklist(person: DataFrame, external_id: DataFrame, k: int = HYDRATION_BATCH) -> DataFrame:
    """Most popular people whose own record was never fetched."""
    ids = _provider_ids(Tables(external_id=external_id), "person", ["tmdb"])
    rows = person.filter(F.col("detail_synced_at").isNull()).join(ids, "id")
    return rows.orderBy(F.col("popularity").desc_nulls_last(), "id").limit(k).select("id", "provider_id", "popularity")


def _observed(t: Tables) -> DataFrame:
    seen = t.availability.groupBy(F.col("title_id").alias("id")).agg(F.max("observed_at").alias("observed_at"))
    return t.title.join(_tracked(t), "id", "left_semi").join(seen, "id", "left")


def availability_worklist(t: Tables, as_of: AsOf, k: int = AVAILABILITY_BATCH) -> DataFrame:
    """Tracked titles whose offers were looked at longest ago, never-observed ones first."""
    rows = _observed(t).join(_provider_ids(t, "title", ["tmdb", "tmdb_tv"]), "id")
    age = seconds_between(F.coalesce("observed_at", F.lit("1970-01-01").cast("timestamp")), timestamp(as_of))
    return rows.orderBy(F.col("observed_at").asc_nulls_first(), "id").limit(k).select(
        "id", "provider_id", "kind", "observed_at", (age > AVAILABILITY_DAYS * 86400).alias("is_stale"))


def availability_stale(t: Tables, as_of: AsOf) -> DataFrame:
    """How many tracked titles have not been observed for three days."""
    age = seconds_between(F.coalesce("observed_at", F.lit("1970-01-01").cast("timestamp")), timestamp(as_of))
    return _observed(t).agg(F.count_if(age > AVAILABILITY_DAYS * 86400).alias("n"))


def missing_episode_worklist(t: Tables) -> DataFrame:
    """Tracked shows without any episode."""
    shows = t.title.filter(F.col("kind") == "show").join(_tracked(t), "id", "left_semi")
    held = t.episode.select(F.col("title_id").alias("id")).distinct()
    return shows.join(held, "id", "left_anti").join(_provider_ids(t, "title", ["tmdb_tv"]), "id").select("id", "provider_id")
