"""Parsed payloads to canonical tables, as idempotent rewrites keyed on natural keys.

``resolved`` maps (kind, source_id) to title_id; ``people`` maps a provider's person id to person_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, timestamp
from tastegraph.functions.text import normalize_title, person_sort_name, slugify
from tastegraph.tables import Tables

# Crew jobs that become predicates, and how much of a payload is kept.
JOB_PREDICATES = {
    "Director": "directed",
    "Screenplay": "wrote",
    "Writer": "wrote",
    "Story": "wrote",
    "Teleplay": "wrote",
    "Original Music Composer": "composed_for",
    "Director of Photography": "shot",
}
CAST_KEPT = 20
COMPANIES_KEPT = 6

# Knowledge-base classes of source works, screen works and series.
WORK_KINDS = {
    "Q7725634": "book", "Q571": "book", "Q47461344": "book", "Q8261": "book", "Q1667921": "book", "Q747381": "book",
    "Q49084": "short_story", "Q25379": "play", "Q7725310": "book", "Q1004": "comic", "Q1760610": "comic",
    "Q8274": "comic", "Q21198342": "comic", "Q1107": "comic", "Q562061": "comic", "Q7889": "game", "Q11410": "game",
    "Q16510064": "true_events", "Q1190554": "true_events", "Q13418847": "true_events", "Q198": "true_events",
    "Q5": "true_events",
}
SCREEN_CLASSES = (
    "Q5398426", "Q11424", "Q24856", "Q1259759", "Q581714", "Q63952888", "Q220898", "Q506240", "Q93204", "Q202866",
    "Q3464665",
)
SERIES_CLASSES = (
    "Q24856", "Q196600", "Q7725310", "Q1667921", "Q13593966", "Q281643", "Q1665149", "Q5398426", "Q47461344",
)
BARE_KEY = r"^Q[0-9]+$"

CREDIT_KEY = ["person_id", "title_id", "predicate", "episode_id", "job"]
# Fixed value: how certain a fact is that comes without a confidence of its own.
CONFIDENCE = 1.0
EDGE_KEY = ["subject_type", "subject_id", "predicate", "object_type", "object_id"]


def lookup(col: Column, values: dict[str, str]) -> Column:
    """A fixed mapping as an expression; NULL for anything else."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[col]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def natural_id(keys: list[str], kind: str = "bigint") -> Column:
    """An id from the natural key, the same on every ingest; NULL parts count as a value of their own."""
    marked = F.concat_ws("\t", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])
    return F.conv(F.substring(F.md5(marked.cast("binary")), 1, 15), 16, 10).cast(kind)


def _identified(rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows with what the payload cannot say: an id and the declared confidence."""
    types = dict(current.dtypes)
    given = {"id": natural_id(keys, types.get("id", "bigint")), "confidence": F.lit(CONFIDENCE).cast(types.get("confidence", "double"))}
    return rows.withColumns({c: v for c, v in given.items() if c in types and c not in rows.columns})


def _upsert(current: DataFrame, incoming: DataFrame, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """Full outer join on ``keys``; ``merge`` gives the value of a column present on both sides.

    Columns not in ``merge`` keep the current value of a current row. Sides are addressed as
    ``c.`` and ``i.``; ``i.__new`` tells whether there is an incoming row.
    """
    c = current.withColumn("__old", F.lit(True)).alias("c")
    i = incoming.withColumn("__new", F.lit(True)).alias("i")
    on = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys])
    both = c.join(i, on, "full")
    old = F.col("__old").isNotNull()
    out = []
    for name in current.columns:
        if name in keys:
            out.append(F.coalesce(f"c.{name}", f"i.{name}").alias(name))
        elif name in merge:
            value = F.when(old & F.col("__new").isNotNull(), merge[name]).when(old, F.col(f"c.{name}"))
            fresh = F.col(f"i.{name}") if name in incoming.columns else F.lit(None)
            out.append(value.otherwise(fresh).alias(name))
        elif name in incoming.columns:
            out.append(F.when(old, F.col(f"c.{name}")).otherwise(F.col(f"i.{name}")).alias(name))
        else:
            out.append(F.col(f"c.{name}").alias(name))
    return both.select(*out)


def _one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the largest by all its columns, so that a task run again keeps the same."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*[c if c in keys else F.col("r")[c].alias(c) for c in rows.columns])


def _latest(incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each natural key; NULL key parts compare as equal."""
    rest = [c for c in incoming.columns if c not in keys]
    return incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


# titles

def movie_rows(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Movies as title rows under their resolved id."""
    year = F.year("release_date")
    ids = resolved.filter(F.col("kind") == "movie").select("source_id", F.col("title_id").alias("title_key"))
    return parsed.join(ids, "source_id").select(
        F.col("title_key").alias("id"), slugify(F.col("title"), F.coalesce(year, F.col("source_id"))).alias("slug"),
        F.lit("movie").alias("kind"), "title", "original_title", normalize_title(F.col("title")).alias("sort_title"),
        "release_date", F.lit(None).cast("date").alias("end_date"), F.col("runtime").alias("runtime_minutes"), "status",
        "poster_path", "popularity", "vote_average", "vote_count")


def show_rows(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Shows as title rows; the runtime is that of the first listed episode length."""
    year = F.year("first_air_date")
    ids = resolved.filter(F.col("kind") == "show").select("source_id", F.col("title_id").alias("title_key"))
    return parsed.join(ids, "source_id").select(
        F.col("title_key").alias("id"), slugify(F.col("name"), F.coalesce(year, F.col("source_id"))).alias("slug"),
        F.lit("show").alias("kind"), F.col("name").alias("title"), F.col("original_name").alias("original_title"),
        normalize_title(F.col("name")).alias("sort_title"), F.col("first_air_date").alias("release_date"),
        F.col("last_air_date").alias("end_date"), F.get("episode_run_time", F.lit(0)).alias("runtime_minutes"), "status",
        "poster_path", "popularity", "vote_average", "vote_count")


def _upsert_titles(title: DataFrame, rows: DataFrame, volatile: list[str], as_of: AsOf) -> DataFrame:
    once = _one(rows, ["id"]).withColumn("synced_at", timestamp(as_of))
    merge = {c: F.col(f"i.{c}") for c in [*volatile, "synced_at"] if c in title.columns}
    return _upsert(title, once, ["id"], merge)


def upsert_movies(title: DataFrame, parsed: DataFrame, resolved: DataFrame, as_of: AsOf) -> DataFrame:
    """Insert new movies; of a known one only popularity, votes and the sync time change."""
    return _upsert_titles(title, movie_rows(parsed, resolved), ["popularity", "vote_average", "vote_count"], as_of)


def upsert_shows(title: DataFrame, parsed: DataFrame, resolved: DataFrame, as_of: AsOf) -> DataFrame:
    """Insert new shows; of a known one only popularity and the sync time change."""
    return _upsert_titles(title, show_rows(parsed, resolved), ["popularity"], as_of)


# credits

def _cast_of(parsed: DataFrame) -> tuple[Column, bool]:
    show = "aggregate_credits" in parsed.columns
    return (F.col("aggregate_credits.cast") if show else F.col("credits.cast")), show


def explode_cast(parsed: DataFrame, top: int = CAST_KEPT) -> DataFrame:
    """The first billed cast as ``acted_in`` credits of the provider's ids; a show gives the first role."""
    cast, show = _cast_of(parsed)
    c = parsed.select("source_id", F.posexplode(F.slice(cast, 1, top)).alias("pos", "c"))
    role = F.get("c.roles", F.lit(0))["character"] if show else F.col("c.character")
    episodes = F.col("c.total_episode_count") if show else F.lit(None).cast("int")
    return c.select(
        "source_id", F.col("c.id").alias("provider_person"), F.col("c.name").alias("person_name"), F.lit("acted_in").alias("predicate"),
        F.lit("Actor").alias("job"), role.alias("character_name_raw"), F.col("c.order").alias("billing_order"),
        episodes.alias("episode_count"), F.col("c.profile_path").alias("profile_path"),
        F.col("c.known_for_department").alias("known_for_department"), F.col("c.popularity").alias("popularity"), "pos")


def explode_crew(parsed: DataFrame, job_map: dict[str, str] | None = None) -> DataFrame:
    """Crew whose job is a predicate; a show's crew member fans out per job."""
    jobs = JOB_PREDICATES if job_map is None else job_map
    if "aggregate_credits" in parsed.columns:
        m = parsed.select("source_id", F.posexplode("aggregate_credits.crew").alias("pos", "c"))
        j = m.select("source_id", "pos", "c", F.explode("c.jobs").alias("j"))
        job, episodes = F.col("j.job"), F.col("j.episode_count")
    else:
        j = parsed.select("source_id", F.posexplode("credits.crew").alias("pos", "c"))
        job, episodes = F.col("c.job"), F.lit(None).cast("int")
    return j.withColumn("predicate", lookup(job, jobs)).filter(F.col("predicate").isNotNull()).select(
        "source_id", F.col("c.id").alias("provider_person"), F.col("c.name").alias("person_name"), "predicate", job.alias("job"),
        F.lit(None).cast("string").alias("character_name_raw"), F.lit(None).cast("int").alias("billing_order"),
        episodes.alias("episode_count"), F.col("c.profile_path").alias("profile_path"),
        F.col("c.known_for_department").alias("known_for_department"), F.col("c.popularity").alias("popularity"), "pos")


def credit_rows(exploded: DataFrame, kind: str, resolved: DataFrame, people: DataFrame) -> DataFrame:
    """Exploded cast or crew under canonical ids."""
    titles = resolved.filter(F.col("kind") == kind).select("source_id", "title_id")
    return exploded.join(titles, "source_id").join(people.select("provider_person", "person_id"), "provider_person").select(
        "person_id", "title_id", F.lit(None).cast(dict(resolved.dtypes)["title_id"]).alias("episode_id"), "predicate", "job",
        "character_name_raw", "billing_order", "episode_count", "pos")


def upsert_credits(credit: DataFrame, incoming: DataFrame) -> DataFrame:
    """Credits by natural key: billing and episode count are replaced, a character name only by another."""
    latest = _latest(incoming, CREDIT_KEY, "pos")
    merge = {
        "billing_order": F.col("i.billing_order"),
        "character_name_raw": F.coalesce("i.character_name_raw", "c.character_name_raw"),
        "episode_count": F.col("i.episode_count"),
    }
    return _upsert(credit, _identified(latest, credit, CREDIT_KEY), CREDIT_KEY, {k: v for k, v in merge.items() if k in credit.columns})


def upsert_edges(edge: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges by natural key; attributes and source of the last write win.

    ``incoming`` has the key, ``attributes``, ``source``, ``provenance`` and ``written_at``.
    """
    latest = _latest(incoming, EDGE_KEY, "written_at")
    return _upsert(edge, _identified(latest, edge, EDGE_KEY), EDGE_KEY, {"attributes": F.col("i.attributes"), "source": F.col("i.source")})


# dimensions and their edges

def _title_edges(rows: DataFrame, kind: str, resolved: DataFrame, predicate: str, object_type: str, source: str = "tmdb") -> DataFrame:
    """Edges from (source_id, object_id) rows."""
    titles = resolved.filter(F.col("kind") == kind).select("source_id", "title_id")
    return rows.join(titles, "source_id").select(
        F.lit("title").alias("subject_type"), F.col("title_id").alias("subject_id"), F.lit(predicate).alias("predicate"),
        F.lit(object_type).alias("object_type"), "object_id", F.lit("asserted").alias("provenance"), F.lit(source).alias("source")).distinct()


def genre_edges(parsed: DataFrame, kind: str, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genre concepts keyed by slug, and the titles' genre edges."""
    g = parsed.select("source_id", F.explode("genres.name").alias("label")).withColumn("slug", slugify(F.col("label")))
    concept = g.groupBy("slug").agg(F.max("label").alias("label")).select(
        F.concat(F.lit("genre:"), "slug").alias("id"), F.lit("genre").alias("scheme"), "slug", "label", F.lit(False).alias("is_curated"))
    rows = g.select("source_id", F.concat(F.lit("genre:"), "slug").alias("object_id"))
    return concept, _title_edges(rows, kind, resolved, "belongs_to_genre", "concept")


def _org_edges(parsed: DataFrame, field: Column, org_kind: str, predicate: str, kind: str, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    o = parsed.select("source_id", F.explode(field).alias("o")).select("source_id", "o.id", "o.name")
    key = F.concat_ws(":", F.lit(org_kind), "id")
    suffix = F.lit("network") if org_kind == "network" else None
    org = o.groupBy(key.alias("key")).agg(F.max("name").alias("name")).select(
        F.col("key").alias("id"), slugify(F.col("name"), suffix).alias("slug"), "name", F.lit(org_kind).alias("kind"))
    rows = o.select("source_id", key.alias("object_id"))
    return org, _title_edges(rows, kind, resolved, predicate, "organization")


def company_edges(parsed: DataFrame, kind: str, resolved: DataFrame, top: int = COMPANIES_KEPT) -> tuple[DataFrame, DataFrame]:
    """Studios keyed ``studio:id``, and ``produced_by`` edges to the first six."""
    return _org_edges(parsed, F.slice("production_companies", 1, top), "studio", "produced_by", kind, resolved)


def network_edges(parsed: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Networks keyed ``network:id``, and ``aired_on`` edges."""
    return _org_edges(parsed, F.col("networks"), "network", "aired_on", "show", resolved)


def collection_edges(parsed: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections of movies, and ``part_of_franchise`` edges."""
    c = parsed.filter(F.col("belongs_to_collection").isNotNull()).select("source_id", "belongs_to_collection.*")
    collection = c.groupBy(F.col("id").cast("string").alias("id")).agg(F.max("name").alias("name")).select(
        "id", slugify(F.col("name")).alias("slug"), F.lit("franchise").alias("kind"), "name")
    rows = c.select("source_id", F.col("id").cast("string").alias("object_id"))
    return collection, _title_edges(rows, "movie", resolved, "part_of_franchise", "collection")


def title_keywords(existing: DataFrame, parsed: DataFrame, kind: str, resolved: DataFrame) -> DataFrame:
    """Keyword assignments with those of the payloads added where absent."""
    titles = resolved.filter(F.col("kind") == kind).select("source_id", "title_id")
    k = parsed.select("source_id", F.explode(F.coalesce("keywords.keywords", "keywords.results")).alias("k")).join(titles, "source_id")
    fresh = k.groupBy("title_id", F.col("k.id").cast("string").alias("keyword_source_id")).agg(F.min("k.name").alias("keyword_label"))
    return existing.unionByName(fresh.join(existing, ["title_id", "keyword_source_id"], "left_anti"))


def upsert_seasons(season: DataFrame, parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Seasons by (title, number); name and announced count are replaced."""
    titles = resolved.filter(F.col("kind") == "show").select("source_id", "title_id")
    s = parsed.select("source_id", F.posexplode("seasons").alias("pos", "s")).join(titles, "source_id").select(
        "title_id", F.col("s.season_number").alias("season_number"), F.col("s.name").alias("name"),
        F.col("s.episode_count").alias("episode_count"), "pos")
    rows = _latest(s, ["title_id", "season_number"], "pos").withColumn("id", F.concat_ws("-", "title_id", "season_number"))
    merge = {c: F.col(f"i.{c}") for c in ("name", "episode_count") if c in season.columns}
    return _upsert(season, rows, ["title_id", "season_number"], merge)


def upsert_episodes(episode: DataFrame, parsed: DataFrame, season: DataFrame, resolved: DataFrame) -> DataFrame:
    """Episodes by (season, number); all described fields are replaced."""
    titles = resolved.filter(F.col("kind") == "show").select("source_id", "title_id")
    seasons = season.select(F.col("id").alias("season_id"), "title_id", "season_number")
    e = parsed.join(titles, "source_id").join(seasons, ["title_id", "season_number"])
    fields = ["name", "air_date", "runtime_minutes"]
    rows = _one(e.select("season_id", "title_id", "episode_number", *fields), ["season_id", "episode_number"]).withColumn(
        "id", F.concat_ws("-", "season_id", "episode_number"))
    merge = {c: F.col(f"i.{c}") for c in fields if c in episode.columns}
    return _upsert(episode, rows, ["season_id", "episode_number"], merge)


# people

def upsert_people(person: DataFrame, credits: DataFrame, people: DataFrame, as_of: AsOf) -> DataFrame:
    """People from credit payloads: new ones created, known ones refreshed in their volatile fields."""
    c = credits.join(people.select("provider_person", "person_id"), "provider_person").groupBy("person_id", "provider_person").agg(
        F.max_by("person_name", "pos").alias("name"), F.max("known_for_department").alias("known_for_department"),
        F.max("profile_path").alias("profile_path"), F.max("popularity").alias("popularity"))
    rows = c.groupBy(F.col("person_id").alias("id")).agg(F.min_by(F.struct(*c.columns[1:]), "provider_person").alias("p")).select(
        "id", slugify(F.col("p.name"), F.col("p.provider_person")).alias("slug"), "p.name", person_sort_name(F.col("p.name")).alias("sort_name"),
        "p.known_for_department", "p.profile_path", "p.popularity", timestamp(as_of).alias("synced_at"))
    merge = {"popularity": F.col("i.popularity"), "profile_path": F.coalesce("i.profile_path", "c.profile_path"), "synced_at": F.col("i.synced_at")}
    return _upsert(person, rows, ["id"], {k: v for k, v in merge.items() if k in person.columns})


def merge_person_detail(person: DataFrame, parsed: DataFrame, people: DataFrame, as_of: AsOf) -> DataFrame:
    """Person details onto known people: biography and dates overwrite, the rest only fills."""
    d = parsed.join(people.select(F.col("provider_person").alias("id"), "person_id"), "id").drop("id").withColumnRenamed("person_id", "id")
    p = person.join(d.select("id", F.struct(*[c for c in d.columns if c != "id"]).alias("d")), "id", "left")
    known = F.col("d").isNotNull()
    out = []
    for name in person.columns:
        c = F.col(name)
        if name in ("biography", "birthday", "deathday", "place_of_birth", "also_known_as"):
            out.append(F.when(known, F.col(f"d.{name}")).otherwise(c).alias(name))
        elif name in ("known_for_department", "profile_path", "popularity"):
            out.append(F.coalesce(f"d.{name}", name).alias(name))
        elif name == "detail_synced_at":
            out.append(F.when(known, timestamp(as_of)).otherwise(c).alias(name))
        else:
            out.append(c)
    return p.select(*out)


def link_external_ids(external_id: DataFrame, incoming: DataFrame, as_of: AsOf) -> DataFrame:
    """Links by (source, source_id, entity_type): the first owner stays, the check time moves."""
    key = ["source", "source_id", "entity_type"]
    rows = incoming.groupBy(*key).agg(F.min_by(F.struct("entity_id", "is_primary"), "seen_no").alias("r")).select(
        *key, "r.*", timestamp(as_of).alias("last_verified"))
    merge = {"last_verified": F.col("i.last_verified")} if "last_verified" in external_id.columns else {}
    return _upsert(external_id, rows, key, merge)


# availability

def sync_availability(current: DataFrame, snapshot: DataFrame, checked: DataFrame, observed_at: AsOf) -> DataFrame:
    """Offers after a snapshot: seen ones open or reopen, unseen ones of a checked region close.

    ``snapshot`` has the offers seen; ``checked`` the (title_id, region) that were asked about, where
    a region without offers closes everything. Rows are closed, never deleted.
    """
    key = ["title_id", "organization_id", "region", "offer_type"]
    seen = snapshot.groupBy(*key).agg(F.max("link").alias("new_link")).withColumn("seen", F.lit(True))
    asked = checked.select("title_id", "region").distinct().withColumn("asked", F.lit(True))
    now = timestamp(observed_at)
    rows = current.join(seen, key, "full").join(asked, ["title_id", "region"], "left")
    hit = F.col("seen").isNotNull()
    closing = ~hit & F.col("asked").isNotNull() & F.col("valid_to").isNull()
    return rows.select(
        *key, F.when(hit, F.col("new_link")).otherwise(F.col("link")).alias("link"),
        F.when(hit, now).otherwise(F.col("observed_at")).alias("observed_at"),
        F.when(hit, F.lit(None)).when(closing, now).otherwise(F.col("valid_to")).alias("valid_to"))


# enrichment

def _named(label: Column) -> Column:
    """A label that is a name and not the bare key."""
    return label.isNotNull() & ~label.rlike(BARE_KEY)


def judge_bindings(bindings: DataFrame) -> DataFrame:
    """Bindings with what each of their facts amounts to: accepted, or why not."""
    source = F.col("based_on").isNotNull() & F.col("based_on_label").isNotNull()
    screen = F.coalesce(F.col("based_on_type").isin(*SCREEN_CLASSES), F.lit(False))
    kind = lookup(F.col("based_on_type"), WORK_KINDS)
    series = F.col("series").isNotNull() & F.col("series_label").isNotNull()
    whitelisted = F.coalesce(F.col("series_type").isin(*SERIES_CLASSES), F.lit(False))
    work = (
        F.when(~source, "none").when(screen, "screen_work").when(kind.isNull(), "unknown_kind")
        .when(~_named(F.col("based_on_label")), "bare_key").otherwise("accepted"))
    # a binding whose source work was skipped is skipped whole
    skipped = work.isin("screen_work", "unknown_kind")
    franchise = (
        F.when(skipped | ~series, "none").when(~whitelisted, "not_a_series")
        .when(~_named(F.col("series_label")), "bare_key").otherwise("accepted"))
    influence = F.when(skipped | F.col("influenced_by").isNull(), "none").otherwise("candidate")
    return bindings.withColumns({"work": work, "work_kind": kind, "franchise": franchise, "influence": influence})


def known_titles(bindings: DataFrame, external_id: DataFrame) -> DataFrame:
    """Bindings of titles we hold, with their title_id."""
    imdb = external_id.filter((F.col("source") == "imdb") & (F.col("entity_type") == "title")).select(
        F.col("source_id").alias("imdb_id"), F.col("entity_id").alias("title_id"))
    return bindings.join(imdb, "imdb_id")


def _facts(rows: DataFrame, predicate: str, object_type: str, target: str) -> DataFrame:
    return rows.select(
        F.lit("title").alias("subject_type"), F.col("title_id").alias("subject_id"), F.lit(predicate).alias("predicate"),
        F.lit(object_type).alias("object_type"), F.col(target).alias("object_id")).distinct()


def based_on_edges(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works titles are based on, and the edges. Screen works and unknown classes are skipped, not guessed."""
    b = judge_bindings(bindings).filter(F.col("work") == "accepted")
    work = b.groupBy(F.col("based_on").alias("id")).agg(F.min(F.struct("based_on_label", "work_kind")).alias("w")).select(
        "id", slugify(F.col("w.based_on_label"), F.lower("id")).alias("slug"), F.col("w.work_kind").alias("kind"),
        F.col("w.based_on_label").alias("title"))
    return work, _facts(b, "based_on", "work", "based_on")


def franchise_edges(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections titles belong to, only where the series is one of works, and the edges."""
    b = judge_bindings(bindings).filter(F.col("franchise") == "accepted")
    collection = b.groupBy(F.col("series").alias("id")).agg(F.min("series_label").alias("name")).select(
        "id", slugify(F.col("name"), F.lower("id")).alias("slug"), F.lit("franchise").alias("kind"), "name")
    return collection, _facts(b, "part_of_franchise", "collection", "series")


def influence_edges(bindings: DataFrame, external_id: DataFrame) -> DataFrame:
    """Title to title, when both are held and differ."""
    other = external_id.filter((F.col("source") == "wikidata") & (F.col("entity_type") == "title")).select(
        F.col("source_id").alias("influenced_by"), F.col("entity_id").alias("other_id"))
    b = judge_bindings(bindings).filter(F.col("influence") == "candidate").join(other, "influenced_by")
    return _facts(b.filter(F.col("other_id") != F.col("title_id")), "influenced_by", "title", "other_id")


def link_authors(work: DataFrame, bindings: DataFrame, person: DataFrame) -> DataFrame:
    """Works with an absent author filled by name, the first id among people of that name."""
    named = judge_bindings(bindings).filter((F.col("work") == "accepted") & _named(F.col("author_label")))
    first = person.groupBy(F.lower("name").alias("author_key")).agg(F.min("id").alias("person_id"))
    author = named.select(F.col("based_on").alias("id"), F.lower("author_label").alias("author_key")).distinct().join(
        first, "author_key").groupBy("id").agg(F.min("person_id").alias("found"))
    return work.join(author, "id", "left").withColumn("author_person_id", F.coalesce("author_person_id", "found")).drop("found")


def enrichment_stats(bindings: DataFrame) -> DataFrame:
    """What an enrichment pass did, in one row."""
    j = judge_bindings(bindings)
    works = F.countDistinct(F.when(F.col("work") == "accepted", F.col("based_on")))
    return j.agg(
        F.countDistinct("imdb_id").alias("processed"), works.alias("works"), F.count_if(F.col("work") == "accepted").alias("based_on"),
        F.count_if(F.col("franchise") == "accepted").alias("franchises"), F.count_if(F.col("franchise") == "not_a_series").alias("rejected_series"),
        F.count_if(F.col("work") == "screen_work").alias("skipped_screen_work"),
        F.count_if(F.col("work") == "unknown_kind").alias("skipped_unknown_kind"))


# migration and fingerprint

def rekey_show_ids(external_id: DataFrame, title: DataFrame) -> DataFrame:
    """Shows' provider ids moved to their own namespace."""
    shows = title.filter(F.col("kind") == "show").select(F.col("id").alias("entity_id"), F.lit(True).alias("is_show"))
    return external_id.join(shows, "entity_id", "left").withColumn(
        "source", F.when((F.col("source") == "tmdb") & (F.col("entity_type") == "title") & F.col("is_show"), "tmdb_tv")
        .otherwise(F.col("source"))).select(*external_id.columns)


def fingerprint(t: Tables, tables: dict[str, list[str]]) -> DataFrame:
    """Rows and an order-insensitive hash of the named columns per table; equal after a second ingest."""
    frames = []
    for name, cols in tables.items():
        signature = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])), 1, 12), 16, 10)
        frames.append(getattr(t, name).agg(F.count("*").alias("n"), F.sum(signature.cast("decimal(20,0)")).alias("signature")).select(
            F.lit(name).alias("table_name"), "n", F.col("signature").cast("string").alias("signature")))
    return _union(frames)

