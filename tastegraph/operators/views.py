"""The semantic views: what applications read, as functions of the tables and a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, recency_decay, release_year, timestamp, today
from tastegraph.operators.edges import edge as logical_edge
from tastegraph.operators.edges import edge_bidirectional, node
from tastegraph.plans.lineage import written
from tastegraph.plans.slices import with_next
from tastegraph.tables import Tables

# Relations a person would call taste, as read from the title.
TASTE_PREDICATES = (
    "directed_by", "written_by", "features_actor", "belongs_to_genre", "explores_theme", "part_of_franchise",
)
# Crew order on a title page.
CREW_RANK = {"directed": 1, "wrote": 2, "composed_for": 3}
TITLE_SOURCES = ("tmdb", "tmdb_tv")
CAST_ON_PAGE = 20
# Watched titles whose nodes one task spells out, and nodes in one list of a title.
WATCHED_IN_PART = 25_000
LINKS_IN_LIST = 256


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group with their rank.

    The filter on row_number sits next to the window, so Spark cuts each task's rows to k before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _links(t: Tables, predicate: str) -> DataFrame:
    return t.edge.filter((F.col("subject_type") == "title") & (F.col("predicate") == predicate))


def _labels(t: Tables, predicate: str, scheme: str, order: Column, name: str) -> DataFrame:
    """Per title the ordered labels of its concepts; a title has few."""
    concept = t.concept.filter(F.col("scheme") == scheme).select(F.col("id").alias("object_id"), "label")
    return (
        _links(t, predicate).join(concept, "object_id")
        .groupBy(F.col("subject_id").alias("id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("label")))),
                         lambda s: s["label"]).alias(name))
    )


def title_view(t: Tables) -> DataFrame:
    """Titles with year, genres, themes, most popular director, franchise and provider id."""
    none = F.array().cast("array<string>")
    genres = _labels(t, "belongs_to_genre", "genre", F.lit(0), "genres")
    themes = _labels(t, "explores_theme", "theme", F.coalesce(-F.col("salience"), F.lit(float("inf"))), "themes")
    director = (
        t.credit.filter((F.col("predicate") == "directed") & F.col("episode_id").isNull())
        .select("title_id", "person_id").distinct()
        .join(t.person.select(F.col("id").alias("person_id"), "name", "popularity"), "person_id")
        .groupBy(F.col("title_id").alias("id"))
        .agg(F.max_by("name", F.struct(F.coalesce("popularity", F.lit(float("-inf"))), -F.col("person_id")))
             .alias("primary_director"))
    )
    franchise = (
        _links(t, "part_of_franchise").select(F.col("subject_id").alias("id"), "object_id")
        .join(t.collection.select(F.col("id").alias("object_id"), "name"), "object_id")
        .groupBy("id").agg(F.min_by("name", "object_id").alias("franchise"))
    )
    provider = (
        t.external_id.filter((F.col("entity_type") == "title") & F.col("source").isin(*TITLE_SOURCES))
        .groupBy(F.col("entity_id").alias("id")).agg(F.min("source_id").alias("tmdb_id"))
    )
    return (
        t.title.withColumn("release_year", release_year(F.col("release_date")))
        .join(genres, "id", "left").join(themes, "id", "left").join(director, "id", "left")
        .join(franchise, "id", "left").join(provider, "id", "left")
        .withColumn("genres", F.coalesce("genres", none)).withColumn("themes", F.coalesce("themes", none))
    )


def person_view(t: Tables) -> DataFrame:
    """People with the number of titles per predicate and the provider id."""
    roles = (
        t.credit.groupBy("person_id", "predicate").agg(F.countDistinct("title_id").alias("n"))
        .groupBy(F.col("person_id").alias("id"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("role_summary"))
    )
    provider = (
        t.external_id.filter((F.col("entity_type") == "person") & (F.col("source") == "tmdb"))
        .groupBy(F.col("entity_id").alias("id")).agg(F.min("source_id").alias("tmdb_id"))
    )
    empty = F.create_map().cast("map<string,bigint>")
    return (
        t.person.join(roles, "id", "left").join(provider, "id", "left")
        .withColumn("role_summary", F.coalesce("role_summary", empty))
    )


def concept_view(t: Tables) -> DataFrame:
    """Concepts with the number of edges that point at them."""
    counts = (
        t.edge.filter(F.col("object_type") == "concept")
        .groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("title_count"))
    )
    return t.concept.join(counts, "id", "left").fillna(0, ["title_count"])


def title_credit(t: Tables) -> DataFrame:
    """Title-level credits with person and character resolved."""
    person = t.person.select(
        F.col("id").alias("person_id"), F.col("name").alias("person_name"), F.col("slug").alias("person_slug"),
        "profile_path", F.col("popularity").alias("person_popularity"),
    )
    character = t.character.select(F.col("id").alias("character_id"), F.col("name").alias("ch_name"))
    return (
        t.credit.filter(F.col("episode_id").isNull())
        .join(person, "person_id").join(character, "character_id", "left")
        .withColumn("character_name", F.coalesce("ch_name", "character_name_raw"))
        .select("id", "title_id", "person_id", "predicate", "job", "billing_order", "person_name", "person_slug",
                "profile_path", "person_popularity", "character_name", "character_id")
    )


def title_full(t: Tables) -> DataFrame:
    """Title view with nested cast (first twenty), crew, sources and franchises."""
    credit = title_credit(t)
    person = [F.col(c) for c in ("person_id", "person_slug", "person_name", "profile_path")]
    unbilled = F.coalesce("billing_order", F.lit(32767))
    cast = (
        top_rows(credit.filter(F.col("predicate") == "acted_in"), ["title_id"],
                 [unbilled, F.col("person_name"), F.col("id")], CAST_ON_PAGE)
        .groupBy(F.col("title_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("rn").alias("position"), *person, "character_name",
                                                  "billing_order"))).alias("cast_members"))
    )
    rank = F.lit(4)
    for predicate, place in CREW_RANK.items():
        rank = F.when(F.col("predicate") == predicate, place).otherwise(rank)
    crew = (
        credit.filter(F.col("predicate") != "acted_in")
        .groupBy(F.col("title_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct(
            rank.alias("rank"), F.col("person_name"), F.col("id").alias("credit_id"), F.col("person_id"),
            F.col("person_slug"), F.col("profile_path"), F.col("job"), F.col("predicate")))).alias("crew"))
    )
    author = t.person.select(F.col("id").alias("author_person_id"), F.col("name").alias("author"))
    work = t.work.join(author, "author_person_id", "left").select(
        F.col("id").alias("object_id"), F.struct("slug", "title", "kind", "author").alias("w"))
    based_on = (
        _links(t, "based_on").join(work, "object_id").groupBy(F.col("subject_id").alias("id"))
        .agg(F.array_sort(F.collect_list("w")).alias("based_on"))
    )
    collection = t.collection.select(
        F.col("id").alias("object_id"), F.struct("id", "slug", "name").alias("c"))
    franchises = (
        _links(t, "part_of_franchise").join(collection, "object_id").groupBy(F.col("subject_id").alias("id"))
        .agg(F.array_sort(F.collect_list("c")).alias("franchises"))
    )
    out = title_view(t)
    for nested in (cast, crew, based_on, franchises):
        out = out.join(nested, "id", "left")
    return out


def availability_current(t: Tables, as_of: AsOf) -> DataFrame:
    """Offers valid at a point in time with their provider."""
    org = t.organization.select(F.col("id").alias("organization_id"), F.col("name").alias("provider_name"))
    return (
        t.availability.filter(F.col("valid_to").isNull() | (F.col("valid_to") > timestamp(as_of)))
        .join(org, "organization_id")
        .select("title_id", "region", "offer_type", "link", "observed_at", "organization_id", "provider_name")
    )


def _aired(as_of: AsOf) -> Column:
    return F.coalesce(F.col("air_date") <= today(as_of), F.lit(False))


def season_view(t: Tables, as_of: AsOf) -> DataFrame:
    """Seasons with the number of episodes held and aired."""
    held = t.episode.groupBy(F.col("season_id").alias("id")).agg(
        F.count("*").alias("episode_count"), F.count_if(_aired(as_of)).alias("aired_count"))
    return t.season.join(held, "id", "left").fillna(0, ["episode_count", "aired_count"])


def episode_view(t: Tables, as_of: AsOf) -> DataFrame:
    """Episodes with season number and whether they have aired."""
    season = t.season.select(F.col("id").alias("season_id"), "season_number")
    return t.episode.join(season, "season_id").withColumn("has_aired", _aired(as_of))


def current_rating(t: Tables) -> DataFrame:
    return t.rating.filter(F.col("superseded_at").isNull()).select("account_id", "title_id", "value", "rated_at")


def _episode_order(t: Tables) -> DataFrame:
    """Episodes with their season number and a struct to show them by."""
    detail = F.struct("id", "season_number", "episode_number", "name", "air_date")
    return t.episode.join(t.season.select(F.col("id").alias("season_id"), "season_number"), "season_id").withColumn(
        "detail", detail)


def progress(t: Tables, episodes: DataFrame) -> DataFrame:
    """Per (account, title) with progress: episodes watched, where the first of them stands in ``episodes``, and the first unseen one after a seen one.

    The first unseen episode is the title's first or follows a seen one. What follows a seen one is seen itself just if
    it stands next among the account's own, so an account's episodes meet the title's once and no account is paired with all of them.
    """
    from pyspark.sql import Window

    key = ["account_id", "title_id"]
    slice_by = F.col("season_number") * 1000 + F.floor(F.col("episode_number") / 1000)
    order = [F.col("season_number"), F.col("episode_number"), F.col("id")]
    following = with_next(episodes, ["title_id"], slice_by, order, F.col("detail"), "after").select(
        F.col("id").alias("episode_id"), F.struct("season_number", "episode_number", "id").alias("at"), "after")
    # progress counts only for episodes that are still part of the title
    seen = (
        t.episode_progress.select("account_id", "episode_id").distinct()
        .join(t.episode.select(F.col("id").alias("episode_id"), "title_id"), "episode_id")
        .join(following, "episode_id", "left")
    )
    known = F.lead("at").over(Window.partitionBy(*key).orderBy("at"))
    open_ = seen.withColumn("known", known["id"]).withColumn(
        "place", F.when(F.col("after").isNotNull() & ~F.col("known").eqNullSafe(F.col("after.id")), F.struct("after.season_number", "after.episode_number", "after.id")))
    return open_.groupBy(*key).agg(
        F.count("*").alias("episodes_watched"), F.min("at").alias("first_seen"), F.min_by("after", "place").alias("next_episode"))


def user_title(t: Tables, as_of: AsOf, aired_only: bool = False) -> DataFrame:
    """Each account's titles with rating, viewings, progress and the next unwatched episode.

    ``aired_only`` leaves episodes that have not aired out of the search for the next one.
    """
    key = ["account_id", "title_id"]
    viewings = t.viewing.groupBy(*key).agg(
        F.count_if(F.col("episode_id").isNull()).alias("view_count"),
        F.min("watched_on").alias("first_watched_on"), F.max("watched_on").alias("last_watched_on"),
    )
    episodes = _episode_order(t)
    offered = episodes.filter(_aired(as_of)) if aired_only else episodes
    per_title = t.episode.groupBy("title_id").agg(F.count_if(_aired(as_of)).alias("episodes_aired"))
    first = offered.groupBy("title_id").agg(
        F.min_by("detail", F.struct("season_number", "episode_number", "id")).alias("first_episode"))
    # what is known of an account and title meets first, what is known of the title last and once
    titles = t.title.select(F.col("id").alias("title_id"), "kind").join(per_title, "title_id", "left").join(first, "title_id", "left")
    out = (
        t.title_state.join(current_rating(t), key, "left").join(viewings, key, "left").join(progress(t, offered), key, "left")
        .join(titles, "title_id")
    )
    aired = F.coalesce("episodes_aired", F.lit(0))
    done = F.coalesce("episodes_watched", F.lit(0))
    nxt = F.when(F.col("first_seen.id") == F.col("first_episode.id"), F.col("next_episode")).otherwise(F.col("first_episode"))
    return out.select(
        "account_id", "title_id", "kind", "status", "is_favorite", "favorited_at", "added_at", "started_at",
        "completed_at", "updated_at", (F.col("value") / 2).alias("rating"), "rated_at",
        F.coalesce("view_count", F.lit(0)).alias("view_count"), "first_watched_on", "last_watched_on",
        F.greatest(F.lit(0), F.date_diff(today(as_of), F.col("added_at").cast("date"))).alias("days_on_watchlist"),
        done.alias("episodes_watched"), aired.alias("episodes_aired"),
        F.when(aired > 0, F.floor(100.0 * done / aired + 0.5).cast("int")).alias("progress_pct"),
        nxt["id"].alias("next_episode_id"), nxt["season_number"].alias("season_number"),
        nxt["episode_number"].alias("episode_number"), nxt["name"].alias("next_episode_name"),
        nxt["air_date"].alias("next_episode_air_date"),
    )


def user_viewing(t: Tables) -> DataFrame:
    """Viewings with their title."""
    title = t.title.select(F.col("id").alias("title_id"), "title", "kind", "poster_path")
    return t.viewing.join(title, "title_id")


def user_core(t: Tables) -> DataFrame:
    """The parts of ``user_title`` taste needs, without episodes: status, rating, last watched."""
    key = ["account_id", "title_id"]
    last = t.viewing.groupBy(*key).agg(F.max("watched_on").alias("last_watched_on"))
    # ids alone look small on disk however many there are, so they are not left to a broadcast
    ids = t.title.select(F.col("id").alias("title_id")).hint("merge")
    return (
        t.title_state.join(current_rating(t), key, "left").join(last, key, "left")
        .select(*key, "status", (F.col("value") / 2).alias("rating"), "last_watched_on", "updated_at")
        .join(ids, "title_id", "left_semi")
        .select(*key, "status", "rating", "last_watched_on", "updated_at")
    )


def _taste_links(t: Tables, distinct_titles: bool) -> DataFrame:
    """Stored: per title and relation the ids of its known nodes, in lists of at most ``LINKS_IN_LIST``."""
    from pyspark.sql import Window

    both = t.edge_both if "edge_both" in t else edge_bidirectional(
        logical_edge(t.credit, t.edge, t.edge_derived), t.predicate_meta)
    edges = both.filter((F.col("subject_type") == "title") & F.col("predicate").isin(*TASTE_PREDICATES)).select(
        F.col("subject_id").alias("title_id"), F.col("object_type").alias("node_type"),
        F.col("object_id").alias("node_id"), "predicate", "canonical_predicate",
    )
    if distinct_titles:
        edges = edges.distinct()
    known = (t.node if "node" in t else node(t)).select("node_type", F.col("id").alias("node_id"))
    relation = ["title_id", "node_type", "predicate", "canonical_predicate"]
    place = F.row_number().over(Window.partitionBy(*relation).orderBy("node_id")) - 1
    lists = edges.join(known, ["node_type", "node_id"], "left_semi").withColumn("list", F.floor(place / LINKS_IN_LIST))
    return written(lists.groupBy(*relation, "list").agg(F.collect_list("node_id").alias("nodes")).drop("list"))


def taste_parts(t: Tables, as_of: AsOf, distinct_titles: bool = False, core: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``user_taste_affinity`` without what is said of their nodes, and the nodes that stand in them with it.

    ``core`` is ``user_core`` where a job holds it already.

    Watched titles travel to their account with lists of nodes, once, and are spelled out there in parts of bounded
    size; whatever else is asked of an account finds its rows together.
    """
    from pyspark.sql import Window

    links = _taste_links(t, distinct_titles)
    nodes = (t.node if "node" in t else node(t)).select(
        "node_type", F.col("id").alias("node_id"), "label", "slug", "image_path")
    scheme = t.concept.select(F.lit("concept").alias("node_type"), F.col("id").alias("node_id"), "scheme")
    met = links.select("node_type", F.explode("nodes").alias("node_id")).distinct()
    known = written(nodes.join(met, ["node_type", "node_id"], "left_semi").join(scheme, ["node_type", "node_id"], "left"))
    mean = F.avg("rating").over(Window.partitionBy("account_id"))
    watched = written((user_core(t) if core is None else core).filter(F.col("status") == "watched").withColumn("mean_rating", mean).drop("status"))
    parts = watched.count() // WATCHED_IN_PART + 1
    grouped = (
        watched.join(links, "title_id").drop("title_id").repartition(parts, "account_id")
        .withColumn("node_id", F.explode("nodes"))
        .groupBy("account_id", "node_type", "node_id", "predicate", "canonical_predicate")
        .agg(F.count("*").alias("n_titles"), F.avg("rating").alias("avg_r"), F.min("mean_rating").alias("mean_rating"),
             F.max("last_watched_on").alias("last_watched_on"), F.max("updated_at").alias("last_update"))
    )
    lift = 1 + F.coalesce(F.col("avg_r") - F.col("mean_rating"), F.lit(0.0)) / 2
    score = F.log1p(F.col("n_titles").cast("double")) * lift * recency_decay(F.col("last_update"), as_of)
    scores = grouped.select(
        "account_id", "node_type", "node_id", "predicate", "canonical_predicate", "n_titles",
        F.round("avg_r", 2).alias("avg_rating"), "last_watched_on", F.round(score, 4).alias("affinity_score"))
    return scores, known


def user_taste_affinity(t: Tables, as_of: AsOf, distinct_titles: bool = False) -> DataFrame:
    """How strongly each account leans to the nodes of the titles it has watched.

    Volume, lift over the account's own mean rating, and recency. ``distinct_titles`` counts a title
    once per node where several edge rows (two writing credits) would count it twice.
    """
    scores, known = taste_parts(t, as_of, distinct_titles)
    return scores.join(known, ["node_type", "node_id"]).select(
        "account_id", "node_type", "node_id", "predicate", "canonical_predicate", "label", "slug",
        "image_path", "scheme", "n_titles", "avg_rating", "last_watched_on", "affinity_score")
