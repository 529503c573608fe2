"""Search over whole query tables, and lookups by provider id, order, person and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.text import normalize_title, person_sort_name, service_name, trigram_similarity
from tastegraph.operators.views import title_credit, top_rows
from tastegraph.plans.grams import containing_texts, similar_texts
from tastegraph.plans.gramtable import GramTable, add_texts, containing_stored, similar_stored
from tastegraph.tables import Tables

MIN_QUERY = 2
# Order of roles in a filmography, and which offers share a section.
ROLE_ORDER = ("directed", "wrote", "acted_in", "composed_for", "shot")
OFFER_SECTIONS = {"flatrate": "stream", "free": "free", "ads": "free", "rent": "rent", "buy": "buy"}


def _usable(queries: DataFrame) -> DataFrame:
    """Trimmed queries of at least two letters as (query_id, q)."""
    q = queries.select("query_id", F.trim("query").alias("q"))
    return q.filter(F.length("q") >= MIN_QUERY)


def _fuzzy_top(queries: DataFrame, items: DataFrame, normalized: Column, k: int, threshold: float, table: GramTable | None = None) -> DataFrame:
    """Top k of items (id, norm, raw, popularity) per query: similar norm, or raw containing the query.

    Items with the same texts are ranked among themselves first, so a crowd of copies costs k rows. With a stored ``table`` of the items'
    norms and lower-case raw texts, no item's grams are made.
    """
    q = _usable(queries).withColumns({"q_norm": normalized, "q_low": F.lower("q")})
    best_copies = top_rows(items.withColumn("low", F.lower("raw")), ["norm", "low"],
                           [F.col("popularity").desc_nulls_last(), F.col("id")], k, "copy")
    texts = items.select("norm", F.lower("raw").alias("low")).distinct()
    asked, needles = q.select(F.col("q_norm").alias("l_text")).distinct(), q.select(F.col("q_low").alias("needle"))
    near = similar_texts(asked, texts.select(F.col("norm").alias("r_text")).distinct(), threshold) if table is None else similar_stored(asked, table, threshold)
    by_norm = q.join(near.withColumnRenamed("l_text", "q_norm"), "q_norm").select(
        "query_id", "q_norm", F.col("r_text").alias("norm")).join(texts, "norm")
    inside = containing_texts(needles, texts.select(F.col("low").alias("text"))) if table is None else containing_stored(needles, table)
    by_text = q.join(inside.withColumnRenamed("needle", "q_low"), "q_low").select(
        "query_id", "q_norm", F.col("text").alias("low")).join(texts, "low")
    cols = ["query_id", "q_norm", "norm", "low"]
    met = by_norm.select(*cols).unionByName(by_text.select(*cols)).distinct()
    scored = met.withColumn("sim", trigram_similarity(F.col("norm"), F.col("q_norm"))).join(best_copies, ["norm", "low"])
    return top_rows(scored, ["query_id"], [F.col("sim").desc(), F.col("popularity").desc_nulls_last(), F.col("id")], k).select(
        "query_id", "id", "sim", "rn")


def title_grams(title: DataFrame, name: str, path: str) -> None:
    """Store, or add to, the grams that ``search_titles`` looks titles up by."""
    add_texts(title.select(F.col("sort_title").alias("text")), title.select(F.lower("title").alias("text")), name, path)


def search_titles(queries: DataFrame, title: DataFrame, k: int = 12, threshold: float = 0.3, table: GramTable | None = None) -> DataFrame:
    """Titles per query by similarity of the normalised title, then popularity; substrings match too. ``table`` is one of ``title_grams``."""
    items = title.select("id", F.col("sort_title").alias("norm"), F.col("title").alias("raw"), "popularity")
    found = _fuzzy_top(queries, items, normalize_title(F.col("q")), k, threshold, table)
    return found.join(title.select("id", "slug", "kind", "title", "poster_path", "popularity"), "id")


def search_people(queries: DataFrame, person: DataFrame, k: int = 8, threshold: float = 0.3) -> DataFrame:
    """People per query by similarity of the sort name, then popularity; substrings match too."""
    items = person.select("id", F.col("sort_name").alias("norm"), F.col("name").alias("raw"), "popularity")
    found = _fuzzy_top(queries, items, person_sort_name(F.col("q")), k, threshold)
    return found.join(person.select("id", "slug", "name", "known_for_department", "profile_path"), "id")


def search_nodes(queries: DataFrame, node: DataFrame, k: int = 10) -> DataFrame:
    """Nodes of any type whose label contains the query: prefixes first, then popularity and label."""
    q = _usable(queries).withColumn("needle", F.lower("q"))
    n = node.select("node_type", "id", "slug", "label", "popularity", F.lower("label").alias("text"))
    copies = top_rows(n, ["text"], [F.col("popularity").desc_nulls_last(), F.col("label"), F.col("node_type"), F.col("id")], k, "copy")
    hits = q.join(containing_texts(q, n), "needle").join(copies, "text")
    order = [F.col("text").startswith(F.col("needle")).desc(), F.col("popularity").desc_nulls_last(), F.col("label"),
             F.col("node_type"), F.col("id")]
    return top_rows(hits, ["query_id"], order, k).select("query_id", "node_type", "id", "slug", "label", "rn")


def merge_results(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local results first, then provider results not already among them by (query, kind, id)."""
    key = ["query_id", "kind", "provider_id"]
    fresh = remote.join(local.select(*key), key, "left_anti")
    cols = [*key, "title", "position"]
    return local.select(*cols, F.lit("local").alias("origin")).unionByName(
        fresh.select(*cols, F.lit("remote").alias("origin")))


def local_by_provider_ids(ids: DataFrame, title: DataFrame) -> DataFrame:
    """Which (kind, provider_id) are held; movie and show numbers are separate namespaces."""
    held = title.select("kind", F.col("tmdb_id").alias("provider_id"), "id", "slug")
    return held.join(ids.select("kind", "provider_id").distinct(), ["kind", "provider_id"])


def titles_in_order(requests: DataFrame, title: DataFrame) -> DataFrame:
    """Held titles with a poster for (request_id, position, kind, provider_id), in request order."""
    held = title.filter(F.col("poster_path").isNotNull()).select(
        "kind", F.col("tmdb_id").alias("provider_id"), "id", "slug", "title", "poster_path")
    return requests.join(held, ["kind", "provider_id"]).orderBy("request_id", "position")


def popular_titles(title: DataFrame, k: int = 18) -> DataFrame:
    """The most popular titles with a poster."""
    return title.filter(F.col("poster_path").isNotNull()).orderBy(
        F.col("popularity").desc_nulls_last(), "id").limit(k)


def title_detail(refs: DataFrame, title_full: DataFrame) -> DataFrame:
    """Full titles by id, slug or (kind, tmdb_id), whichever columns ``refs`` has."""
    keys = [c for c in ("id", "slug", "kind", "tmdb_id") if c in refs.columns]
    return title_full.join(refs.select(*keys).distinct(), keys, "left_semi")


def filmography(person_ids: DataFrame, t: Tables) -> DataFrame:
    """Distinct titles per person and role, roles in their fixed order, newest first."""
    shown = t.title.select(F.col("id").alias("title_id"), "title", F.year("release_date").alias("release_year"))
    credits = title_credit(t).join(person_ids.select("person_id").distinct(), "person_id", "left_semi")
    once = credits.groupBy("person_id", "predicate", "title_id").agg(F.min_by("character_name", "id").alias("character_name"))
    roles = F.array(*[F.lit(r) for r in ROLE_ORDER])
    return once.join(shown, "title_id").withColumn("role_rank", F.array_position(roles, F.col("predicate"))).orderBy(
        "person_id", "role_rank", F.desc_nulls_last("release_year"), "title_id")


def where_to_watch(refs: DataFrame, availability: DataFrame) -> DataFrame:
    """Offers per (title_id, region) by section, one per service, with the region's first link."""
    a = availability.join(refs.select("title_id", F.upper("region").alias("region")).distinct(), ["title_id", "region"], "left_semi")
    section = F.lit(None).cast("string")
    for kind, name in OFFER_SECTIONS.items():
        section = F.when(F.col("offer_type") == kind, name).otherwise(section)
    o = a.withColumns({"section": section, "service": service_name(F.col("provider_name"))})
    offer = (
        o.groupBy("title_id", "region", "section", "service")
        .agg(F.min(F.struct("provider_name", "offer_type")).alias("first"))
        .groupBy("title_id", "region", "section")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("first.provider_name"), F.col("service")))),
                         lambda s: s["service"]).alias("services"))
    )
    link = a.filter(F.col("link").isNotNull()).groupBy("title_id", "region").agg(
        F.min_by("link", F.struct("provider_name", "offer_type", "link")).alias("link"))
    return offer.join(link, ["title_id", "region"], "left")
