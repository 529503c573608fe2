"""Payloads built from parts, suppliers and lines, parsed back and upserted."""

from pyspark.sql import functions as F

from tastegraph.demo.catalog.flow import movie_payloads
from tastegraph.demo.model import AS_OF
from tastegraph.demo.registry import query
from tastegraph.operators import ingest as I
from tastegraph.sources import payloads as P

c = F.col
NOW = f"TIMESTAMP '{AS_OF}'"


def _text(name):
    return c(name).cast("string")


def _digits(name):
    return F.regexp_extract(name, "[0-9]+", 0).cast("bigint")


# shows: large parts with their lines as a running cast and crew

def show_payloads(t):
    """One show payload per large part: its brand as genre, its maker as studio and network, its lines as cast, crew and seasons."""
    lines = t.lineitem.groupBy(c("l_partkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(
        c("l_orderkey").alias("order"), c("l_linenumber").alias("n"), c("l_suppkey").alias("p"), c("l_returnflag").alias("f"), c("l_quantity").cast("int").alias("q")))).alias("x"))
    who = lambda e: [e["p"].alias("id"), F.concat(F.lit("Person "), e["p"].cast("string")).alias("name")]
    cast = F.transform(F.filter("x", lambda e: e["n"] >= 5), lambda e: F.struct(
        *who(e), e["q"].alias("total_episode_count"), e["order"].cast("int").alias("order"),
        F.array(F.struct(F.concat(F.lit("C"), e["f"]).alias("character"), F.lit("k").alias("credit_id"))).alias("roles")))
    job = lambda e: F.element_at(F.array(*[F.lit(j) for j in ("Director", "Story", "Original Music Composer", "Gaffer")]), e["n"])
    crew = F.transform(F.filter("x", lambda e: e["n"] <= 4), lambda e: F.struct(
        *who(e), F.array(F.struct(job(e).alias("job"), F.lit("k").alias("credit_id"), e["q"].alias("episode_count"))).alias("jobs")))
    seasons = F.transform(F.array_sort(F.array_distinct(F.transform("x", lambda e: e["n"]))), lambda n: F.struct(
        n.alias("id"), n.alias("season_number"), F.concat(F.lit("Season "), n.cast("string")).alias("name"),
        F.size(F.filter("x", lambda e: e["n"] == n)).alias("episode_count")))
    named = lambda i, n: F.array(F.struct(i.alias("id"), n.alias("name")))
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(F.length(w).alias("id"), w.alias("name")))
    body = F.to_json(F.struct(
        c("p_partkey").alias("id"), c("p_name").alias("name"), F.when(c("p_size") % 5 == 0, "soon").otherwise(F.format_string("1999-%02d-09", c("p_size") % 12 + 1)).alias("first_air_date"),
        F.array("p_size").alias("episode_run_time"), F.lit("Ended").alias("status"), c("p_retailprice").alias("popularity"), named(F.lit(1), c("p_brand")).alias("genres"),
        named(_digits("p_brand"), c("p_brand")).alias("networks"), named(_digits("p_brand"), c("p_type")).alias("production_companies"), seasons.alias("seasons"),
        F.struct(cast.alias("cast"), crew.alias("crew")).alias("aggregate_credits"), F.struct(words.alias("results")).alias("keywords")))
    return t.part.filter("p_size > 25").join(lines, c("p_partkey") == c("id")).drop("id").select(_text("p_partkey").alias("source_id"), body.alias("payload"))


def _shows(t):
    return P.parse_show(show_payloads(t))


def _movies(t):
    """Movies with a studio and a collection beside what ``movie_payloads`` has."""
    extra = t.part.select(
        _text("p_partkey").alias("source_id"), F.array(F.struct(_digits("p_brand").alias("id"), c("p_type").alias("name"))).alias("pc"),
        F.struct(F.length("p_type").cast("bigint").alias("id"), F.concat(F.lit("Saga "), F.length("p_type").cast("string")).alias("name")).alias("bc"))
    parsed = P.parse_movie(movie_payloads(t)).join(extra, "source_id")
    return parsed.withColumns({"production_companies": c("pc"), "belongs_to_collection": c("bc")}).drop("pc", "bc")


def _resolved(t):
    kind = F.when(c("p_size") > 25, "show").otherwise("movie")
    return t.part.select(kind.alias("kind"), _text("p_partkey").alias("source_id"), c("p_partkey").alias("title_id"))


def _people(t):
    return t.supplier.select(c("s_suppkey").alias("provider_person"), c("s_suppkey").alias("person_id"))


_LINES = "(SELECT l.*, p.* FROM lineitem l JOIN part p ON p_partkey = l_partkey)"
_ORDERED = "row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity)"


@query("parse_show", f"""
    SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN make_date(1999, p_size % 12 + 1, 9) END AS first_air_date, p_size AS runtime,
           p_brand AS genre, p_brand AS network, count(DISTINCT l_linenumber) AS seasons, count(*) FILTER (l_linenumber > 4) AS n_cast, count(*) FILTER (l_linenumber < 5) AS n_crew
    FROM {_LINES} WHERE p_size > 25 GROUP BY ALL""")
def parse_show(t):
    first = lambda x: F.get(x, F.lit(0))["name"]
    return _shows(t).select(
        "source_id", "name", "first_air_date", F.get("episode_run_time", F.lit(0)).alias("runtime"), first("genres").alias("genre"), first("networks").alias("network"),
        F.size("seasons").cast("bigint").alias("seasons"), F.size("aggregate_credits.cast").cast("bigint").alias("n_cast"), F.size("aggregate_credits.crew").cast("bigint").alias("n_crew"))


@query("explode_show_credits", f"""
    SELECT CAST(l_partkey AS VARCHAR) AS source_id, l_suppkey AS provider_person, predicate, job, episode_count FROM (
        SELECT *, 'acted_in' AS predicate, 'Actor' AS job, CAST(l_quantity AS INTEGER) AS episode_count FROM {_LINES} WHERE p_size > 25 AND l_linenumber > 4 QUALIFY {_ORDERED} <= 20
        UNION ALL SELECT *, ['directed', 'wrote', 'composed_for'][l_linenumber], ['Director', 'Story', 'Original Music Composer'][l_linenumber], CAST(l_quantity AS INTEGER)
        FROM {_LINES} WHERE p_size > 25 AND l_linenumber < 4) x""")
def explode_show_credits(t):
    s = _shows(t)
    return I.explode_cast(s).unionByName(I.explode_crew(s)).select("source_id", "provider_person", "predicate", "job", "episode_count")


# known titles: those of a brand that ends in five; the others are new

_KNOWN = "p_brand LIKE '%5'"


def _known_titles(t, kind):
    held = t.part.filter("p_brand like '%5'").select(c("p_partkey").alias("id"))
    return t.title.filter(c("kind") == kind).join(held, "id", "left_semi").withColumns(
        {"synced_at": F.lit(None).cast("timestamp"), "vote_average": F.lit(1.5), "vote_count": F.lit(7).cast("bigint")})


def _titles_sql(show: bool) -> str:
    size = "p_size > 25" if show else "p_size <= 25"
    votes = "CASE WHEN known THEN 7 END" if show else "NULL::BIGINT"
    return f"""
    SELECT id, CASE WHEN known THEN t.title ELSE p_name END AS title, p_retailprice AS popularity, {votes} AS vote_count, {NOW} AS synced_at
    FROM (SELECT *, {_KNOWN} AS known FROM part WHERE {size} AND p_partkey IN (SELECT l_partkey FROM lineitem)) p JOIN {{title}} t ON t.id = p_partkey
    UNION ALL SELECT t.id, t.title, t.popularity, 7, NULL FROM part p JOIN {{title}} t ON t.id = p_partkey
    WHERE {size} AND {_KNOWN} AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)"""


@query("upsert_movies", _titles_sql(False))
def upsert_movies(t):
    return I.upsert_movies(_known_titles(t, "movie"), _movies(t), _resolved(t), AS_OF).select("id", "title", "popularity", "vote_count", "synced_at")


@query("upsert_shows", _titles_sql(True))
def upsert_shows(t):
    return I.upsert_shows(_known_titles(t, "show"), _shows(t), _resolved(t), AS_OF).select("id", "title", "popularity", "vote_count", "synced_at")


def _show_credits(t):
    s = _shows(t)
    exploded = I.explode_cast(s).unionByName(I.explode_crew(s))
    return exploded, I.credit_rows(exploded, "show", _resolved(t), _people(t))


_SHOW_CREDITS = f"""
    given AS (
        SELECT *, l_linenumber > 4 AS acts, {_ORDERED.replace('PARTITION BY l_partkey', 'PARTITION BY l_partkey, l_linenumber > 4')} AS pos
        FROM {_LINES} WHERE p_size > 25 QUALIFY acts AND pos <= 20 OR l_linenumber < 4),
    incoming AS (
        SELECT l_suppkey AS person_id, l_partkey AS title_id, CASE WHEN acts THEN 'acted_in' ELSE ['directed', 'wrote', 'composed_for'][l_linenumber] END AS predicate,
               CASE WHEN acts THEN 'Actor' ELSE ['Director', 'Story', 'Original Music Composer'][l_linenumber] END AS job, arg_max(CAST(l_quantity AS INTEGER), pos) AS episode_count
        FROM given GROUP BY 1, 2, 3, 4)"""


def _held_credits(t, incoming):
    """Directors are known already, without an episode count."""
    return incoming.filter("predicate = 'directed'").select(
        c("person_id"), c("title_id"), "predicate", "episode_id", "job").distinct().withColumns({
            "id": c("person_id") * 1_000_000 + c("title_id"), "character_name_raw": F.lit("kept"), "billing_order": F.lit(9), "episode_count": F.lit(None).cast("int"), "confidence": F.lit(0.5)})


@query("upsert_credits", f"""
    WITH {_SHOW_CREDITS}
    SELECT person_id, title_id, predicate, job, episode_count, CASE predicate WHEN 'directed' THEN 'kept' WHEN 'acted_in' THEN 'C' END AS role,
           CASE predicate WHEN 'directed' THEN 0.5 ELSE 1.0 END AS confidence, true AS has_id, predicate = 'directed' AS old_id FROM incoming""")
def upsert_credits(t):
    _, incoming = _show_credits(t)
    out = I.upsert_credits(_held_credits(t, incoming), incoming)
    role = F.when(c("predicate") == "acted_in", F.substring("character_name_raw", 1, 1)).otherwise(c("character_name_raw"))
    return out.select("person_id", "title_id", "predicate", "job", "episode_count", role.alias("role"), "confidence", c("id").isNotNull().alias("has_id"),
                      (c("id") == c("person_id") * 1_000_000 + c("title_id")).alias("old_id"))


@query("genre_edges", """
    SELECT 'genre:brand-' || substr(p_brand, 7) AS object_id, p_partkey AS subject_id, 'belongs_to_genre' AS predicate, 'concept' AS object_type, p_brand AS label
    FROM part WHERE p_size > 25 AND p_partkey IN (SELECT l_partkey FROM lineitem)""")
def genre_edges(t):
    concept, edges = I.genre_edges(_shows(t), "show", _resolved(t))
    return edges.join(concept.select(c("id").alias("object_id"), "label"), "object_id").select("object_id", "subject_id", "predicate", "object_type", "label")


@query("company_edges", """
    WITH m AS (SELECT *, 'studio:' || regexp_extract(p_brand, '[0-9]+') AS object_id FROM part WHERE p_size <= 25 AND p_partkey IN (SELECT l_partkey FROM lineitem))
    SELECT object_id, p_partkey AS subject_id, 'produced_by' AS predicate, max(p_type) OVER (PARTITION BY object_id) AS name FROM m""")
def company_edges(t):
    org, edges = I.company_edges(_movies(t), "movie", _resolved(t))
    return edges.join(org.select(c("id").alias("object_id"), "name"), "object_id").select("object_id", "subject_id", "predicate", "name")


@query("network_edges", """
    SELECT 'network:' || regexp_extract(p_brand, '[0-9]+') AS object_id, p_partkey AS subject_id, 'aired_on' AS predicate,
           lower(replace(p_brand, '#', '-')) || '-network' AS slug FROM part WHERE p_size > 25 AND p_partkey IN (SELECT l_partkey FROM lineitem)""")
def network_edges(t):
    org, edges = I.network_edges(_shows(t), _resolved(t))
    return edges.join(org.select(c("id").alias("object_id"), "slug"), "object_id").select("object_id", "subject_id", "predicate", "slug")


@query("collection_edges", """
    SELECT CAST(length(p_type) AS VARCHAR) AS object_id, p_partkey AS subject_id, 'part_of_franchise' AS predicate, 'saga-' || length(p_type) AS slug
    FROM part WHERE p_size <= 25 AND p_partkey IN (SELECT l_partkey FROM lineitem)""")
def collection_edges(t):
    collection, edges = I.collection_edges(_movies(t), _resolved(t))
    return edges.join(collection.select(c("id").alias("object_id"), "slug"), "object_id").select("object_id", "subject_id", "predicate", "slug")


@query("upsert_edges", """
    SELECT p_partkey AS subject_id, CAST(length(p_type) AS VARCHAR) AS object_id, CASE WHEN p_type LIKE 'SM%' THEN 0.25 ELSE 1.0 END AS confidence,
           'tmdb' AS source, true AS has_id, p_type LIKE 'SM%' AS old_id
    FROM part WHERE p_size <= 25 AND p_partkey IN (SELECT l_partkey FROM lineitem)""")
def upsert_edges(t):
    _, edges = I.collection_edges(_movies(t), _resolved(t))
    incoming = edges.withColumns({"attributes": F.lit("{}"), "written_at": F.lit(1)})
    small = t.part.filter("p_type like 'SM%'").select(c("p_partkey").alias("subject_id"))
    held = edges.join(small, "subject_id", "left_semi").withColumns(
        {"id": -c("subject_id"), "confidence": F.lit(0.25), "attributes": F.lit("old"), "source": F.lit("old")})
    out = I.upsert_edges(held, incoming)
    return out.select("subject_id", "object_id", "confidence", "source", c("id").isNotNull().alias("has_id"), (c("id") == -c("subject_id")).alias("old_id"))


_WORDS = """(SELECT p_partkey AS title_id, w, min(p_size) AS size FROM (SELECT *, unnest(string_split(p_name, ' ')) AS w FROM part
        WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) x GROUP BY ALL)"""


@query("title_keywords", f"""
    SELECT title_id, CAST(length(w) AS VARCHAR) AS keyword_source_id, CASE WHEN length(w) = 5 THEN 'five' ELSE min(w) END AS keyword_label
    FROM {_WORDS} x WHERE size > 25 GROUP BY title_id, length(w)""")
def title_keywords(t):
    # keywords of five letters are there already under another label
    none = t.title.limit(0).select(c("id").alias("title_id"), F.lit("").alias("keyword_source_id"), F.lit("").alias("keyword_label"))
    fresh = I.title_keywords(none, _shows(t), "show", _resolved(t))
    held = fresh.filter("keyword_source_id = '5'").withColumn("keyword_label", F.lit("five"))
    return I.title_keywords(held, _shows(t), "show", _resolved(t))


@query("upsert_seasons", """
    SELECT l_partkey AS title_id, l_linenumber AS season_number, 'Season ' || l_linenumber AS name, CAST(count(*) AS INTEGER) AS episode_count, l_partkey || '-' || l_linenumber AS id
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY 1, 2""")
def upsert_seasons(t):
    none = t.title.limit(0).select(F.lit("").alias("id"), c("id").alias("title_id"), F.lit(0).alias("season_number"), F.lit("").alias("name"), F.lit(0).alias("episode_count"))
    once = I.upsert_seasons(none, _shows(t), _resolved(t))
    stale = once.filter("season_number = 1").withColumns({"name": F.lit("old"), "episode_count": F.lit(0)})
    return I.upsert_seasons(stale, _shows(t), _resolved(t)).select("title_id", c("season_number").cast("int").alias("season_number"), "name", "episode_count", "id")


# season payloads: the lines of one number are its episodes

def season_payloads(t):
    e = F.struct(c("l_orderkey").alias("episode_number"), c("l_linenumber").alias("season_number"), c("l_linestatus").alias("name"),
                 F.date_format("l_shipdate", "yyyy-MM-dd").alias("air_date"), c("l_quantity").cast("int").alias("runtime"))
    large = t.part.filter("p_size > 25").select(c("p_partkey").alias("l_partkey"))
    # of lines that repeat a number the first of the table holds
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    once = t.lineitem.select("l_partkey", "l_linenumber", "l_orderkey", e.alias("e"), place.alias("place")).join(large, "l_partkey").groupBy(
        "l_partkey", "l_linenumber", "l_orderkey").agg(F.min_by("e", "place").alias("e"))
    return once.groupBy("l_partkey", "l_linenumber").agg(F.sort_array(F.collect_list("e")).alias("episodes")).select(
        _text("l_partkey").alias("source_id"), F.to_json(F.struct(c("l_linenumber").alias("season_number"), "episodes")).alias("payload"))


_EPISODES = "(SELECT DISTINCT ON (l_partkey, l_linenumber, l_orderkey) * FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25)"


@query("parse_season", f"""
    SELECT CAST(l_partkey AS VARCHAR) AS source_id, l_linenumber AS season_number, CAST(l_orderkey AS INTEGER) AS episode_number, l_linestatus AS name,
           CAST(l_shipdate AS DATE) AS air_date, CAST(l_quantity AS INTEGER) AS runtime_minutes FROM {_EPISODES} x""")
def parse_season(t):
    return P.parse_season(season_payloads(t)).select("source_id", "season_number", "episode_number", "name", "air_date", "runtime_minutes")


@query("upsert_episodes", f"""
    SELECT l_partkey || '-' || l_linenumber AS season_id, CAST(l_orderkey AS INTEGER) AS episode_number, l_linestatus AS name, CAST(l_quantity AS INTEGER) AS runtime_minutes,
           l_partkey || '-' || l_linenumber || '-' || l_orderkey AS id FROM {_EPISODES} x""")
def upsert_episodes(t):
    parsed = P.parse_season(season_payloads(t))
    seasons = t.lineitem.select(F.concat_ws("-", "l_partkey", "l_linenumber").alias("id"), c("l_partkey").alias("title_id"), c("l_linenumber").alias("season_number")).distinct()
    none = t.title.limit(0).select(
        F.lit("").alias("id"), F.lit("").alias("season_id"), c("id").alias("title_id"), F.lit(0).alias("episode_number"), F.lit("").alias("name"),
        F.lit(None).cast("date").alias("air_date"), F.lit(0).alias("runtime_minutes"))
    once = I.upsert_episodes(none, parsed, seasons, _resolved(t))
    stale = once.filter("name = 'F'").withColumns({"name": F.lit("old"), "runtime_minutes": F.lit(0)})
    return I.upsert_episodes(stale, parsed, seasons, _resolved(t)).select("season_id", "episode_number", "name", "runtime_minutes", "id")


# people

@query("upsert_people", f"""
    WITH {_SHOW_CREDITS}
    SELECT DISTINCT person_id AS id, CASE WHEN person_id <= 20 THEN 'Old name' ELSE 'Person ' || person_id END AS name,
           CASE WHEN person_id <= 20 THEN 'old' ELSE 'person-' || person_id || '-' || person_id END AS slug, {NOW} AS synced_at FROM incoming
    UNION ALL SELECT s_suppkey, 'Old name', 'old', NULL FROM supplier WHERE s_suppkey <= 20 AND s_suppkey NOT IN (SELECT person_id FROM incoming)""")
def upsert_people(t):
    exploded, _ = _show_credits(t)
    held = t.supplier.filter("s_suppkey <= 20").select(
        c("s_suppkey").alias("id"), F.lit("old").alias("slug"), F.lit("Old name").alias("name"), F.lit("x").alias("sort_name"), F.lit(None).cast("string").alias("known_for_department"),
        F.lit(None).cast("string").alias("profile_path"), F.lit(0.0).alias("popularity"), F.lit(None).cast("timestamp").alias("synced_at"))
    return I.upsert_people(held, exploded, _people(t), AS_OF).select("id", "name", "slug", "synced_at")


def person_payloads(t):
    body = F.to_json(F.struct(
        c("s_suppkey").alias("id"), c("s_name").alias("name"), F.array("s_name", F.reverse("s_name")).alias("also_known_as"),
        F.when(c("s_nationkey") % 5 == 0, "unknown").otherwise(F.format_string("19%02d-03-01", c("s_nationkey") + 40)).alias("birthday"),
        F.concat(F.lit("About "), "s_name").alias("biography"), c("s_acctbal").alias("popularity"), F.when(c("s_acctbal") > 5000, "/p.jpg").alias("profile_path")))
    return t.supplier.select(_text("s_suppkey").alias("source_id"), body.alias("payload"))


@query("parse_person", """
    SELECT CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, s_name || '|' || reverse(s_name) AS aliases, CASE WHEN s_nationkey % 5 <> 0 THEN make_date(1940 + s_nationkey, 3, 1) END AS birthday,
           'About ' || s_name AS biography FROM supplier""")
def parse_person(t):
    return P.parse_person(person_payloads(t)).select("source_id", "name", F.array_join("also_known_as", "|").alias("aliases"), "birthday", "biography")


@query("merge_person_detail", f"""
    SELECT s_suppkey AS id, CASE WHEN s_nationkey < 20 THEN 'About ' || s_name ELSE 'old' END AS biography,
           CASE WHEN s_nationkey >= 20 THEN DATE '1900-01-01' WHEN s_nationkey % 5 <> 0 THEN make_date(1940 + s_nationkey, 3, 1) END AS birthday,
           CASE WHEN s_nationkey < 20 AND s_acctbal > 5000 THEN '/p.jpg' ELSE '/old.jpg' END AS profile_path, CASE WHEN s_nationkey < 20 THEN {NOW} END AS detail_synced_at FROM supplier""")
def merge_person_detail(t):
    held = t.supplier.select(
        c("s_suppkey").alias("id"), F.lit("old").alias("biography"), F.to_date(F.lit("1900-01-01")).alias("birthday"), F.lit("/old.jpg").alias("profile_path"),
        F.lit(None).cast("timestamp").alias("detail_synced_at"))
    south = t.supplier.filter("s_nationkey < 20").select(_text("s_suppkey").alias("source_id"))
    parsed = P.parse_person(person_payloads(t)).join(south, "source_id", "left_semi")
    return I.merge_person_detail(held, parsed, _people(t), AS_OF)


@query("link_external_ids", f"""
    SELECT 'imdb' AS source, 'tt' || p_size AS source_id, CASE WHEN p_size < 10 THEN -1 ELSE min(p_partkey) END AS entity_id, {NOW} AS last_verified FROM part GROUP BY p_size
    UNION ALL SELECT 'imdb', 'tt0', -1, NULL""")
def link_external_ids(t):
    # sizes stand for provider ids that several titles claim; the small ones have an owner already
    given = t.part.select(F.lit("imdb").alias("source"), F.concat(F.lit("tt"), "p_size").alias("source_id"), F.lit("title").alias("entity_type"),
                          c("p_partkey").alias("entity_id"), F.lit(True).alias("is_primary"), c("p_partkey").alias("seen_no"))
    held = t.part.select(F.explode(F.array(c("p_size"), F.lit(0))).alias("n")).filter("n < 10").distinct().select(
        F.lit("imdb").alias("source"), F.concat(F.lit("tt"), "n").alias("source_id"), F.lit("title").alias("entity_type"), F.lit(-1).cast("bigint").alias("entity_id"),
        F.lit(False).alias("is_primary"), F.lit(None).cast("timestamp").alias("last_verified"))
    return I.link_external_ids(held, given, AS_OF).select("source", "source_id", "entity_id", "last_verified")


@query("parse_watch_providers", """
    SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS source_id, l_linestatus AS region, CASE l_returnflag WHEN 'A' THEN 'rent' WHEN 'N' THEN 'flatrate' ELSE 'buy' END AS offer_type,
           l_suppkey AS provider_id, 'Service ' || l_suppkey AS provider_name, 'l/' || l_partkey AS link FROM lineitem""")
def parse_watch_providers(t):
    o = F.struct(c("l_suppkey").alias("provider_id"), F.concat(F.lit("Service "), "l_suppkey").alias("provider_name"))
    only = lambda f: F.collect_set(F.when(c("l_returnflag") == f, o))
    regions = t.lineitem.groupBy("l_partkey", "l_linestatus").agg(F.struct(
        F.concat(F.lit("l/"), F.first("l_partkey").cast("string")).alias("link"), only("N").alias("flatrate"), only("A").alias("rent"), only("R").alias("buy")).alias("r"))
    raw = regions.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "r"))).alias("results")).select(
        _text("l_partkey").alias("source_id"), F.to_json(F.struct(c("l_partkey").alias("id"), "results")).alias("payload"))
    return P.parse_watch_providers(raw)


# knowledge-base bindings: a part's type, size and brand say what it is based on, in which series, by whom

_CLASSES = ("Q571", "Q49084", "Q11424", "Q999", "Q25379")
_SERIES = ("Q24856", "Q5", "Q277759")


def binding_payloads(t):
    v = lambda x: F.struct(x.cast("string").alias("value"))
    at = lambda x: F.concat(F.lit("http://kb/entity/"), x)
    pick = lambda values, by: F.element_at(F.array(*[F.lit(x) for x in values]), (by % len(values) + 1).cast("int"))
    key = F.concat(F.lit("Q"), F.length("p_type").cast("string"))
    b = F.struct(
        v(F.concat(F.lit("tt"), c("p_partkey").cast("string"))).alias("imdb"), v(at(key)).alias("basedOn"),
        v(F.when(F.length("p_type") % 7 == 0, key).otherwise(F.concat(F.lit("Work "), F.length("p_type").cast("string")))).alias("basedOnLabel"),
        v(at(pick(_CLASSES, c("p_size")))).alias("basedOnType"), v(F.concat(F.lit("Supplier#"), F.lpad((F.length("p_type") % 9 + 1).cast("string"), 9, "0"))).alias("authorLabel"),
        v(at(F.concat(F.lit("Q90"), (c("p_size") % 6).cast("string")))).alias("series"), v(c("p_brand")).alias("seriesLabel"),
        v(at(pick(_SERIES, c("p_size")))).alias("seriesType"), v(at(F.concat(F.lit("Q7"), (c("p_partkey") % 50).cast("string")))).alias("influencedBy"))
    return t.part.select(_text("p_partkey").alias("source_id"), F.to_json(F.struct(F.struct(F.array(b).alias("bindings")).alias("results"))).alias("payload"))


def _bindings(t):
    ids = t.part.select(F.lit("imdb").alias("source"), F.concat(F.lit("tt"), c("p_partkey").cast("string")).alias("source_id"), F.lit("title").alias("entity_type"), c("p_partkey").alias("entity_id"))
    return I.known_titles(P.parse_bindings(binding_payloads(t)), ids)


_BOUND = f"""
    bound AS (
        SELECT *, 'Q' || length(p_type) AS based_on, {list(_CLASSES)}[p_size % 5 + 1] AS class, length(p_type) % 7 = 0 AS bare, 'Q90' || (p_size % 6) AS series,
               {list(_SERIES)}[p_size % 3 + 1] AS series_class FROM part),
    judged AS (
        SELECT *, CASE class WHEN 'Q11424' THEN 'screen_work' WHEN 'Q999' THEN 'unknown_kind' ELSE CASE WHEN bare THEN 'bare_key' ELSE 'accepted' END END AS work,
               CASE class WHEN 'Q571' THEN 'book' WHEN 'Q49084' THEN 'short_story' WHEN 'Q25379' THEN 'play' END AS work_kind FROM bound),
    facts AS (SELECT *, CASE WHEN work IN ('screen_work', 'unknown_kind') THEN 'none' WHEN series_class <> 'Q24856' THEN 'not_a_series' ELSE 'accepted' END AS franchise FROM judged)"""


@query("judge_bindings", f"WITH {_BOUND} SELECT 'tt' || p_partkey AS imdb_id, based_on, work, CASE WHEN class <> 'Q11424' THEN work_kind END AS work_kind, franchise FROM facts")
def judge_bindings(t):
    return I.judge_bindings(P.parse_bindings(binding_payloads(t))).select("imdb_id", "based_on", "work", "work_kind", "franchise")


@query("based_on_edges", f"""
    WITH {_BOUND}, kinds AS (SELECT based_on, min(work_kind) AS kind FROM facts WHERE work = 'accepted' GROUP BY 1)
    SELECT p_partkey AS subject_id, based_on AS object_id, kind, 'work-' || length(p_type) || '-q' || length(p_type) AS slug FROM facts JOIN kinds USING (based_on) WHERE work = 'accepted'""")
def based_on_edges(t):
    work, edges = I.based_on_edges(_bindings(t))
    return edges.join(work.select(c("id").alias("object_id"), "kind", "slug"), "object_id").select("subject_id", "object_id", "kind", "slug")


@query("franchise_edges", f"""
    WITH {_BOUND}, names AS (SELECT series, min(p_brand) AS name FROM facts WHERE franchise = 'accepted' GROUP BY 1)
    SELECT p_partkey AS subject_id, series AS object_id, name FROM facts JOIN names USING (series) WHERE franchise = 'accepted'""")
def franchise_edges(t):
    collection, edges = I.franchise_edges(_bindings(t))
    return edges.join(collection.select(c("id").alias("object_id"), "name"), "object_id").select("subject_id", "object_id", "name")


@query("influence_edges", f"""
    WITH {_BOUND} SELECT p_partkey AS subject_id, p_partkey % 50 AS object_id FROM facts
    WHERE work IN ('accepted', 'bare_key') AND p_partkey % 50 IN (SELECT p_partkey FROM part) AND p_partkey % 50 <> p_partkey""")
def influence_edges(t):
    ids = t.part.select(F.lit("wikidata").alias("source"), F.concat(F.lit("Q7"), c("p_partkey").cast("string")).alias("source_id"), F.lit("title").alias("entity_type"), c("p_partkey").alias("entity_id"))
    return I.influence_edges(_bindings(t), ids).select("subject_id", "object_id")


@query("link_authors", f"""
    WITH {_BOUND} SELECT DISTINCT based_on AS id, CASE WHEN length(p_type) % 2 = 0 THEN -1 ELSE (SELECT min(s_suppkey) FROM supplier
           WHERE s_name = 'Supplier#' || lpad(CAST(length(p_type) % 9 + 1 AS VARCHAR), 9, '0')) END AS author_person_id FROM facts WHERE work = 'accepted'""")
def link_authors(t):
    # works with an even number have an author already
    work, _ = I.based_on_edges(_bindings(t))
    even = F.regexp_extract("id", "[0-9]+", 0).cast("bigint") % 2 == 0
    held = work.withColumn("author_person_id", F.when(even, F.lit(-1)).cast("bigint"))
    return I.link_authors(held, _bindings(t), t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"))).select("id", "author_person_id")


@query("enrichment_stats", f"""
    WITH {_BOUND} SELECT count(DISTINCT p_partkey) AS processed, count(DISTINCT based_on) FILTER (work = 'accepted') AS works, count(*) FILTER (work = 'accepted') AS based_on,
           count(*) FILTER (franchise = 'accepted') AS franchises, count(*) FILTER (franchise = 'not_a_series') AS rejected_series,
           count(*) FILTER (work = 'screen_work') AS skipped_screen_work, count(*) FILTER (work = 'unknown_kind') AS skipped_unknown_kind FROM facts""")
def enrichment_stats(t):
    return I.enrichment_stats(_bindings(t))


@query("reingest_fingerprint", """
    SELECT 'season' AS table_name, count(DISTINCT (l_partkey, l_linenumber)) AS n, true AS same FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25""")
def reingest_fingerprint(t):
    """A second run over the same payloads leaves rows and signature as they were."""
    none = t.title.limit(0).select(F.lit("").alias("id"), c("id").alias("title_id"), F.lit(0).alias("season_number"), F.lit("").alias("name"), F.lit(0).alias("episode_count"))
    once = I.upsert_seasons(none, _shows(t), _resolved(t))
    twice = I.upsert_seasons(once, _shows(t), _resolved(t))
    cols = {"season": ["id", "title_id", "season_number", "name", "episode_count"]}
    a, b = (I.fingerprint(t.replace(season=x), cols) for x in (once, twice))
    return a.join(b.select("table_name", c("signature").alias("again"), c("n").alias("n2")), "table_name").select(
        "table_name", "n", ((c("signature") == c("again")) & (c("n") == c("n2"))).alias("same"))
