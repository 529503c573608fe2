"""Event folds, operational analytics, payloads and ingest."""

from pyspark.sql import functions as F

from tastegraph.demo.model import AS_OF, EVENTS_AS_OF, LISTING_AS_OF
from tastegraph.demo.oracle_views import NOW, TODAY
from tastegraph.demo.registry import query
from tastegraph.operators import edges as E
from tastegraph.operators import events as V
from tastegraph.operators import ingest as I
from tastegraph.operators import merge as M
from tastegraph.operators import ops as O
from tastegraph.operators import views as W
from tastegraph.sources import export as X
from tastegraph.sources import listings as L
from tastegraph.sources import payloads as P

c = F.col
ENOW = f"TIMESTAMP '{EVENTS_AS_OF}'"
LDAY = f"DATE '{LISTING_AS_OF[:10]}'"


@query("fold_status", """
    SELECT account_id, title_id, first(status ORDER BY occurred_at DESC, event_id DESC) AS status, min(occurred_at) AS added_at,
           min(occurred_at) FILTER (WHERE status IN ('watching', 'watched')) AS started_at,
           min(occurred_at) FILTER (WHERE status = 'watched') AS completed_at, max(occurred_at) AS updated_at
    FROM {status_intent} GROUP BY 1, 2""")
def fold_status(t):
    return V.fold_status(t.status_intent)


# abandoning counts as removal here
_WITH_REMOVALS = "SELECT account_id, title_id, event_id, occurred_at, CASE status WHEN 'abandoned' THEN 'removed' ELSE status END AS status FROM {status_intent}"


def _with_removals(t):
    return t.status_intent.withColumn("status", F.when(c("status") == "abandoned", V.REMOVED).otherwise(c("status")))


@query("remove_titles", f"""
    WITH e AS ({_WITH_REMOVALS}) SELECT account_id, title_id, event_id, status FROM e WHERE NOT EXISTS (
        SELECT 1 FROM e r WHERE r.account_id = e.account_id AND r.title_id = e.title_id AND r.status = 'removed'
        AND (r.occurred_at > e.occurred_at OR (r.occurred_at = e.occurred_at AND r.event_id >= e.event_id)))""")
def remove_titles(t):
    return V.remove_titles(_with_removals(t)).select("account_id", "title_id", "event_id", "status")


@query("status_transitions", f"""
    WITH e AS ({_WITH_REMOVALS}), p AS (SELECT *, lag(status) OVER (PARTITION BY account_id, title_id ORDER BY occurred_at, event_id) AS b FROM e)
    SELECT account_id, title_id, event_id, occurred_at, 'status_change' AS event_kind, nullif(b, 'removed') AS from_status, status AS to_status
    FROM p WHERE status <> 'removed' AND nullif(b, 'removed') IS DISTINCT FROM status""")
def status_transitions(t):
    return V.status_transitions(_with_removals(t))


@query("fold_favorites", """
    SELECT account_id, title_id, count(*) % 2 = 1 AS is_favorite, CASE WHEN count(*) % 2 = 1 THEN max(occurred_at) END AS favorited_at,
           min(occurred_at) AS first_toggled_at FROM {status_intent} GROUP BY 1, 2""")
def fold_favorites(t):
    return V.fold_favorites(t.status_intent)


_RATED = """SELECT orderkey * 10 + lineno AS event_id, account_id, title_id, ship AS occurred_at,
    CASE WHEN flag <> 'R' THEN CAST(ceil(qty / 5) AS INTEGER) END AS value FROM {line}"""


def _rated(t):
    return t.line.select((c("orderkey") * 10 + c("lineno")).alias("event_id"), "account_id", "title_id", c("ship").alias("occurred_at"),
                         F.when(c("flag") != "R", F.ceil(c("qty") / 5).cast("int")).alias("value"))


@query("rating_history", f"""
    SELECT id, account_id, title_id, value, rated_at, superseded_at FROM (
        SELECT event_id AS id, account_id, title_id, value, occurred_at AS rated_at,
               lead(occurred_at) OVER (PARTITION BY account_id, title_id ORDER BY occurred_at, event_id) AS superseded_at FROM ({_RATED}) r) x
    WHERE value IS NOT NULL""")
def rating_history(t):
    return V.rating_history(_rated(t))


@query("stamp_rewatch", """
    SELECT v.id, EXISTS (SELECT 1 FROM {viewing} e WHERE e.account_id = v.account_id AND e.title_id = v.title_id AND e.episode_id IS NULL
           AND (e.created_at < v.created_at OR (e.created_at = v.created_at AND e.id < v.id))) AS is_rewatch FROM {viewing} v""")
def stamp_rewatch(t):
    return V.stamp_rewatch(t.viewing).select("id", "is_rewatch")


@query("apply_watch_events", """
    WITH b AS (SELECT account_id, title_id, min(odate) AS first_at, max(odate) AS updated_at FROM {line} WHERE flag = 'A' GROUP BY 1, 2)
    SELECT b.account_id, b.title_id, 'watched' AS status, coalesce(s.added_at, b.first_at) AS added_at, coalesce(s.started_at, b.first_at) AS started_at,
           coalesce(s.completed_at, b.first_at) AS completed_at, b.updated_at FROM b LEFT JOIN {title_state} s USING (account_id, title_id)""")
def apply_watch_events(t):
    batch = t.line.filter("flag = 'A'").select(
        (c("orderkey") * 10 + c("lineno")).alias("event_id"), "account_id", "title_id", c("odate").alias("occurred_at"), (c("qty") / 10).alias("stars"),
        F.lit(None).cast("date").alias("watched_on"), F.lit("day").alias("date_precision"))
    return V.apply_watch_events(batch, t)["title_state"]


@query("expand_progress", """
    WITH ev AS (SELECT p.account_id, p.title_id, p.watched_at, e.season_number AS s, e.episode_number AS n
                FROM {episode_progress} p JOIN {o_episode_view} e ON e.id = p.episode_id)
    SELECT ev.account_id, ev.title_id, e.id AS episode_id, min(ev.watched_at) AS watched_at FROM ev JOIN {o_episode_view} e
    ON e.title_id = ev.title_id AND e.has_aired AND (e.season_number < ev.s OR (e.season_number = ev.s AND e.episode_number <= ev.n)) GROUP BY 1, 2, 3""")
def expand_progress(t):
    events = t.episode_progress.select(
        c("episode_id").alias("event_id"), "account_id", "title_id", c("watched_at").alias("occurred_at"), F.lit("through").alias("action"), "episode_id",
        F.lit(None).cast("int").alias("season_number"))
    return V.expand_progress(events, W.episode_view(t, AS_OF))


@query("progress_effects", """
    WITH w AS (SELECT account_id, title_id, count(*) AS watched FROM {episode_progress} GROUP BY 1, 2),
         a AS (SELECT title_id, count(*) FILTER (WHERE has_aired) AS aired FROM {o_episode_view} GROUP BY 1)
    SELECT w.account_id, w.title_id, w.watched, coalesce(a.aired, 0) AS aired, s.status AS from_status,
           NOT coalesce(s.status IN ('watching', 'watched'), false) AS starts,
           coalesce(a.aired, 0) > 0 AND w.watched >= coalesce(a.aired, 0) AND s.status IS DISTINCT FROM 'watched' AS just_completed
    FROM w LEFT JOIN a USING (title_id) LEFT JOIN {title_state} s USING (account_id, title_id)""")
def progress_effects(t):
    return V.progress_effects(t.episode_progress, W.episode_view(t, AS_OF), t.title_state)


@query("sliding_limit", """
    WITH h AS (SELECT user_id AS bucket, event_id AS hit_id, ts, floor(epoch_us(ts) / 86400e6) AS w FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY bucket, w ORDER BY ts, hit_id) AS cur FROM h),
    n AS (SELECT bucket, w, count(*) AS hits FROM h GROUP BY 1, 2),
    x AS (SELECT p.*, coalesce(n.hits, 0) * (1 - (epoch_us(ts) / 86400e6 - p.w)) + cur AS est FROM p LEFT JOIN n ON n.bucket = p.bucket AND n.w = p.w - 1)
    SELECT bucket, hit_id, ts, est <= 5 AS allowed, CAST(greatest(0, 5 - ceil(est)) AS INTEGER) AS remaining,
           CAST(greatest(1, ceil((w + 1) * 86400 - epoch_us(ts) / 1e6)) AS INTEGER) AS retry_after_s FROM x""")
def sliding_limit(t):
    return V.sliding_limit(t.events.select(c("user_id").alias("bucket"), c("event_id").alias("hit_id"), "ts"), 5, 86400)


@query("snapshot_shares", """
    SELECT s.slug, s.account_id, s.title_id, CASE WHEN s.include_rating THEN (
        SELECT max(r.value) FROM {rating} r WHERE r.account_id = s.account_id AND r.title_id = s.title_id AND r.rated_at <= s.created_at
        AND (r.superseded_at IS NULL OR r.superseded_at > s.created_at)) END AS rating_snapshot FROM {share} s""")
def snapshot_shares(t):
    return V.snapshot_shares(t.share, t.rating).select("slug", "account_id", "title_id", "rating_snapshot")


@query("count_views", """
    SELECT v.slug, count(*) AS view_count FROM {share_view} v JOIN {share} s ON s.slug = v.slug
    WHERE NOT regexp_matches(v.user_agent, '(?i)bot|crawler|spider|facebookexternalhit|slackbot|whatsapp|telegram|discord|preview|curl|wget|headless')
      AND (s.revoked_at IS NULL OR v.ts < s.revoked_at) GROUP BY 1""")
def count_views(t):
    return V.count_views(t.share_view, t.share)


_ERASED = "(SELECT id FROM {account} WHERE deleted_at IS NOT NULL)"


@query("erase_accounts", " UNION ALL ".join(
    f"SELECT {col} AS account_id, '{name}' AS entity, count(*) AS rows_deleted FROM {{{tab}}} WHERE {col} IN {_ERASED} GROUP BY 1"
    for tab, col, name in (("share", "account_id", "share"), ("rating", "account_id", "rating"), ("episode_progress", "account_id", "episode_progress"),
                           ("viewing", "account_id", "viewing"), ("title_state", "account_id", "title_state"), ("auth_session", "user_id", "session"),
                           ("account", "id", "account"))))
def erase_accounts(t):
    return V.erase_accounts(t, t.account.filter("deleted_at IS NOT NULL").select(c("id").alias("account_id")))[1]


# operations

@query("queue_summary", f"""
    SELECT count(*) FILTER (WHERE status = 'queued') AS depth,
           CAST(floor((epoch_us({ENOW}) - epoch_us(min(run_after) FILTER (WHERE status = 'queued'))) / 1e6 + 0.5) AS BIGINT) AS oldest,
           first(kind ORDER BY run_after, id) FILTER (WHERE status = 'queued') AS oldest_kind,
           count(*) FILTER (WHERE status = 'failed' AND created_at > {ENOW} - INTERVAL 24 HOUR) AS failed_24h FROM {{job}}""")
def queue_summary(t):
    return O.queue_summary(t.job, EVENTS_AS_OF)


@query("queued_by_kind", f"""
    SELECT kind, CAST(floor((epoch_us({ENOW}) - epoch_us(min(run_after))) / 1e6 + 0.5) AS BIGINT) AS oldest, count(*) AS n
    FROM {{job}} WHERE status = 'queued' GROUP BY 1""")
def queued_by_kind(t):
    return O.queued_by_kind(t.job, EVENTS_AS_OF)


@query("kind_freshness", f"""
    SELECT kind, last_success, age_s, failures, coalesce(kind <> 'hydrate_title' AND age_s > 172800, false) AS is_stale, failures >= 3 AS is_failing FROM (
        SELECT kind, max(finished_at) FILTER (WHERE status = 'done') AS last_success,
               CAST(floor((epoch_us({ENOW}) - epoch_us(max(finished_at) FILTER (WHERE status = 'done'))) / 1e6 + 0.5) AS BIGINT) AS age_s,
               count(*) FILTER (WHERE status = 'failed') AS failures FROM {{job}} GROUP BY 1) x""")
def kind_freshness(t):
    return O.kind_freshness(t.job, EVENTS_AS_OF)


_AGE = f"CASE WHEN release_date IS NULL OR release_date > {TODAY} - 180 OR (kind = 'show' AND status IN ('Returning Series', 'In Production', 'Planned', 'Pilot')) THEN 7 ELSE 90 END"
_OLD = f"(epoch_us({NOW}) - epoch_us(synced_at)) / 1e6"


@query("corpus_freshness", f"""
    SELECT count(*) AS titles, count(*) FILTER (WHERE {_OLD} < {_AGE} * 86400) AS fresh,
           CAST(floor(100.0E0 * count(*) FILTER (WHERE {_OLD} < {_AGE} * 86400) / count(*) + 0.5) AS INTEGER) AS pct_fresh FROM {{title}}""")
def corpus_freshness(t):
    return O.corpus_freshness(t.title, AS_OF)


_COUNTED = {"people": "person", "credits": "credit", "edges": "edge", "derived_edges": "edge_derived", "concepts": "concept", "collections": "collection",
            "organizations": "organization", "works": "work", "characters": "character", "seasons": "season", "episodes": "episode"}


@query("entity_counts", " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS n FROM {{{tab}}}" for n, tab in _COUNTED.items())
       + " UNION ALL SELECT 'people_detailed', count(*) FROM {person} WHERE detail_synced_at IS NOT NULL")
def entity_counts(t):
    return O.entity_counts(t)


@query("failure_diagnostics", """
    SELECT kind, status, substr(last_error, 1, 500) AS last_error, max(attempts) AS attempts, count(*) AS n FROM {job} WHERE last_error IS NOT NULL
    GROUP BY 1, 2, 3 ORDER BY n DESC, kind, status, last_error LIMIT 10""")
def failure_diagnostics(t):
    return O.failure_diagnostics(t.job)


@query("graph_stats", """
    WITH th AS (SELECT DISTINCT subject_id AS id FROM {edge} WHERE predicate = 'explores_theme'), us AS (SELECT predicate, count(*) AS n FROM {o_edge} GROUP BY 1)
    SELECT 'titles' AS stat, count(*) AS value FROM {title}
    UNION ALL SELECT 'themed_pct', CAST(floor(100.0E0 * (SELECT count(*) FROM {title} WHERE id IN (SELECT id FROM th)) / count(*) + 0.5) AS BIGINT) FROM {title}
    UNION ALL SELECT 'people', count(*) FROM {person} UNION ALL SELECT 'edges', count(*) FROM {o_edge}
    UNION ALL SELECT 'predicates_in_use', count(*) FROM us UNION ALL SELECT 'predicates_declared', count(*) FROM {o_meta}
    UNION ALL SELECT 'themes', count(*) FROM {concept} WHERE scheme = 'theme'
    UNION ALL SELECT 'characters_resolved_pct', CAST(floor(100.0E0 * count(character_id) / count(*) + 0.5) AS BIGINT) FROM {credit} WHERE predicate = 'acted_in'
    UNION ALL SELECT 'node_types', 7
    UNION ALL SELECT * FROM (SELECT 'top:' || predicate, n FROM us ORDER BY n DESC, predicate LIMIT 8) q""")
def graph_stats(t):
    return O.graph_stats(t, E.edge(t.credit, t.edge, t.edge_derived))


@query("ontology_stats", """
    SELECT 'titles' AS entity, count(*) AS n FROM {title} UNION ALL SELECT 'people', count(*) FROM {person} UNION ALL SELECT 'credits', count(*) FROM {credit}
    UNION ALL SELECT 'edges', (SELECT count(*) FROM {edge}) + (SELECT count(*) FROM {edge_derived}) UNION ALL SELECT 'concepts', count(*) FROM {concept}
    UNION ALL SELECT 'predicates', count(*) FROM {o_meta} UNION ALL SELECT 'predicates_in_use', count(DISTINCT predicate) FROM {o_edge}""")
def ontology_stats(t):
    return O.ontology_stats(t, E.edge(t.credit, t.edge, t.edge_derived), t.predicate_meta)


@query("stale_worklist", f"""
    SELECT t.id, x.source_id AS provider_id, t.kind, t.id IN (SELECT title_id FROM {{title_state}}) AS tracked,
           release_date IS NULL OR release_date > {TODAY} - 180 AS recent, synced_at
    FROM {{title}} t JOIN {{external_id}} x ON x.entity_type = 'title' AND x.entity_id = t.id AND x.source IN ('tmdb', 'tmdb_tv')
    WHERE {_OLD} > {_AGE} * 43200 ORDER BY tracked DESC, recent DESC, synced_at, t.id LIMIT 60""")
def stale_worklist(t):
    return O.stale_worklist(t, AS_OF)


@query("hydration_worklist", """
    SELECT p.id, x.source_id AS provider_id, p.popularity FROM {person} p JOIN {external_id} x ON x.entity_type = 'person' AND x.entity_id = p.id AND x.source = 'tmdb'
    WHERE p.detail_synced_at IS NULL ORDER BY p.popularity DESC NULLS LAST, p.id LIMIT 25""")
def hydration_worklist(t):
    return O.hydration_worklist(t.person, t.external_id)


@query("availability_worklist", f"""
    SELECT t.id, x.source_id AS provider_id, t.kind, a.at AS observed_at, coalesce(a.at, TIMESTAMP '1970-01-01 00:00:00') < {NOW} - INTERVAL 3 DAY AS is_stale
    FROM {{title}} t JOIN {{external_id}} x ON x.entity_type = 'title' AND x.entity_id = t.id AND x.source IN ('tmdb', 'tmdb_tv')
    LEFT JOIN (SELECT title_id, max(observed_at) AS at FROM {{availability}} GROUP BY 1) a ON a.title_id = t.id
    WHERE t.id IN (SELECT title_id FROM {{title_state}}) ORDER BY a.at NULLS FIRST, t.id LIMIT 30""".replace(" AS at ", " AS seen_at ").replace("a.at", "a.seen_at"))
def availability_worklist(t):
    return O.availability_worklist(t, AS_OF)


@query("missing_episode_worklist", """
    SELECT t.id, x.source_id AS provider_id FROM {title} t JOIN {external_id} x ON x.entity_type = 'title' AND x.entity_id = t.id AND x.source = 'tmdb_tv'
    WHERE t.kind = 'show' AND t.id IN (SELECT title_id FROM {title_state})
      AND t.id NOT IN (SELECT title_id FROM {episode} WHERE air_date < DATE '1997-01-01')""")
def missing_episode_worklist(t):
    # episodes before 1997 stand for those already fetched
    return O.missing_episode_worklist(t.replace(episode=t.episode.filter("air_date < DATE '1997-01-01'")))


# listings

_KIND = "CASE media_type WHEN 'tv' THEN 'show' WHEN 'movie' THEN 'movie' END"


@query("union_listings", f"""
    SELECT {_KIND} AS kind, provider_id, min(CASE WHEN popularity > 940 THEN position ELSE position + 1000000 END) AS position FROM {{listing}} WHERE media_type <> 'person' GROUP BY 1, 2""")
def union_listings(t):
    # two listings that overlap: what is popular, and after it what is not very popular
    rest = t.listing.filter("popularity <= 960").withColumn("position", c("position") + 1_000_000)
    return L.union_listings([t.listing.filter("popularity > 940"), rest])


@query("new_releases", f"""
    SELECT {_KIND} AS kind, provider_id, title, release_date, popularity FROM {{listing}} WHERE media_type <> 'person' AND title <> '' AND poster_path IS NOT NULL
    AND release_date BETWEEN {LDAY} - 90 AND {LDAY} AND vote_count >= CASE media_type WHEN 'movie' THEN 25 ELSE 15 END ORDER BY popularity DESC, 1, 2 LIMIT 12""")
def new_releases(t):
    return L.new_releases(t.listing, LISTING_AS_OF)


@query("upcoming", f"""
    SELECT {_KIND} AS kind, provider_id, title, release_date, popularity FROM {{listing}} WHERE media_type <> 'person' AND title <> '' AND poster_path IS NOT NULL
    AND release_date > {LDAY} AND release_date <= {LDAY} + 365 ORDER BY release_date, popularity DESC, 1, 2 LIMIT 12""")
def upcoming(t):
    return L.upcoming(t.listing, LISTING_AS_OF)


@query("trending", f"""
    SELECT {_KIND} AS kind, provider_id, title, position FROM {{listing}} WHERE media_type <> 'person' AND title <> '' AND poster_path IS NOT NULL
    ORDER BY position LIMIT 18""")
def trending(t):
    return L.trending(t.listing)


# payloads: built from parts and their lines, then parsed back

def movie_payloads(t):
    """One movie payload per small part, with its lines as cast and crew."""
    lines = t.lineitem.groupBy(c("l_partkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(
        c("l_orderkey").alias("order"), c("l_linenumber").alias("n"), c("l_suppkey").alias("p"), c("l_returnflag").alias("f")))).alias("x"))
    name = lambda e: F.concat(F.lit("Person "), e["p"].cast("string"))
    cast = F.transform(F.filter("x", lambda e: e["n"] >= 5), lambda e: F.struct(
        e["p"].alias("id"), name(e).alias("name"), F.concat(F.lit("C"), e["f"]).alias("character"), F.lit("k").alias("credit_id"), e["order"].cast("int").alias("order")))
    crew = F.transform(F.filter("x", lambda e: e["n"] <= 4), lambda e: F.struct(
        e["p"].alias("id"), name(e).alias("name"),
        F.element_at(F.array(*[F.lit(j) for j in ("Director", "Story", "Original Music Composer", "Gaffer")]), e["n"]).alias("job"), F.lit("k").alias("credit_id")))
    genre = F.array(F.struct(F.lit(1).alias("id"), c("p_brand").alias("name")))
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(F.length(w).alias("id"), w.alias("name")))
    body = F.to_json(F.struct(
        c("p_partkey").alias("id"), c("p_name").alias("title"), F.when(c("p_size") % 5 == 0, "").otherwise(F.format_string("2001-%02d-15", c("p_size") % 12 + 1)).alias("release_date"),
        c("p_size").alias("runtime"), c("p_retailprice").alias("popularity"), genre.alias("genres"),
        F.struct(cast.alias("cast"), crew.alias("crew")).alias("credits"), F.struct(words.alias("keywords")).alias("keywords")))
    return t.part.filter("p_size <= 25").join(lines, c("p_partkey") == c("id")).drop("id").select(
        c("p_partkey").cast("string").alias("source_id"), body.alias("payload"))


@query("parse_movie", """
    SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_partkey AS id, p_name AS title,
           CASE WHEN p_size % 5 <> 0 THEN CAST('2001-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-15' AS DATE) END AS release_date,
           p_size AS runtime, p_retailprice AS popularity, p_brand AS genre, count(*) FILTER (WHERE l_linenumber >= 5) AS n_cast, count(*) FILTER (WHERE l_linenumber <= 4) AS n_crew
    FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY ALL""")
def parse_movie(t):
    m = P.parse_movie(movie_payloads(t))
    return m.select("source_id", "id", "title", "release_date", "runtime", "popularity", F.get("genres", F.lit(0))["name"].alias("genre"),
                    F.size("credits.cast").cast("bigint").alias("n_cast"), F.size("credits.crew").cast("bigint").alias("n_crew"))


@query("explode_cast", """
    SELECT source_id, provider_person, predicate, character_name_raw, billing_order FROM (
        SELECT CAST(l_partkey AS VARCHAR) AS source_id, l_suppkey AS provider_person, 'acted_in' AS predicate, 'C' || l_returnflag AS character_name_raw,
               CAST(l_orderkey AS INTEGER) AS billing_order, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag) AS rn
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 AND l_linenumber >= 5) x WHERE rn <= 20""")
def explode_cast(t):
    return I.explode_cast(P.parse_movie(movie_payloads(t))).select("source_id", "provider_person", "predicate", "character_name_raw", "billing_order")


@query("explode_crew", """
    SELECT CAST(l_partkey AS VARCHAR) AS source_id, l_suppkey AS provider_person, CASE l_linenumber WHEN 1 THEN 'directed' WHEN 2 THEN 'wrote' ELSE 'composed_for' END AS predicate,
           CASE l_linenumber WHEN 1 THEN 'Director' WHEN 2 THEN 'Story' ELSE 'Original Music Composer' END AS job
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 AND l_linenumber <= 3""")
def explode_crew(t):
    return I.explode_crew(P.parse_movie(movie_payloads(t))).select("source_id", "provider_person", "predicate", "job")


@query("raw_capture", """
    SELECT event_type AS resource, CAST(user_id AS VARCHAR) AS source_id, 'full' AS variant, first(props ORDER BY ts DESC) AS payload, max(ts) AS fetched_at FROM events GROUP BY 1, 2""")
def raw_capture(t):
    raw = t.events.select(c("event_type").alias("resource"), c("user_id").cast("string").alias("source_id"), F.lit("full").alias("variant"), c("props").alias("payload"),
                          c("ts").alias("fetched_at"))
    return P.raw_capture(raw.filter("resource < 'p'"), raw)


@query("split_rejects", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN '$' WHEN event_type = 'view' THEN 'k' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'tags[1].id'
                          WHEN event_type = 'click' AND event_id % 3 = 1 THEN 'tags[0].id,tags[2].id' END AS failed_at FROM events""")
def split_rejects(t):
    tags = F.when(c("event_id") % 3 == 0, '{"id": 1}, {"id": null}, {"id": 3}').when(c("event_id") % 3 == 1, '{"id": "x"}, {"id": 2}, {}').otherwise('{"id": 1}')
    broken = F.when(c("event_type") == "error", F.substring("props", 1, 5)).when(c("event_type") == "view", F.lit('{"j": 1}')).when(
        c("event_type") == "click", F.concat(F.lit('{"k": 1, "tags": ['), tags, F.lit("]}"))).otherwise(c("props"))
    good, bad = P.split_rejects(t.events.select("event_id", broken.alias("payload")), "k int, tags array<struct<id:int>>", ["k", "tags[].id"])
    return good.select("event_id", F.lit(None).cast("string").alias("failed_at")).unionByName(bad.select("event_id", "failed_at"))


@query("prune_payloads", f"SELECT event_id, ts AS fetched_at FROM events WHERE ts >= {ENOW} - INTERVAL 10 DAY")
def prune_payloads(t):
    return P.prune_payloads(t.events.select("event_id", c("ts").alias("fetched_at")), EVENTS_AS_OF, 10)


@query("sync_availability", """
    WITH k AS (SELECT DISTINCT title_id, region FROM {availability_snapshot} WHERE snapshot_no = 2), s AS (SELECT * FROM {availability_snapshot} WHERE snapshot_no = 2)
    SELECT coalesce(a.title_id, s.title_id) AS title_id, coalesce(a.organization_id, s.organization_id) AS organization_id, coalesce(a.region, s.region) AS region,
           coalesce(a.offer_type, s.offer_type) AS offer_type, CASE WHEN s.title_id IS NOT NULL THEN s.link ELSE a.link END AS link,
           CASE WHEN s.title_id IS NOT NULL THEN TIMESTAMP '2001-12-31 00:00:00' ELSE a.observed_at END AS observed_at,
           CASE WHEN s.title_id IS NOT NULL THEN NULL WHEN a.valid_to IS NULL AND k.title_id IS NOT NULL THEN TIMESTAMP '2001-12-31 00:00:00' ELSE a.valid_to END AS valid_to
    FROM {availability} a FULL JOIN s ON s.title_id = a.title_id AND s.organization_id = a.organization_id AND s.region = a.region AND s.offer_type = a.offer_type
    LEFT JOIN k ON k.title_id = coalesce(a.title_id, s.title_id) AND k.region = coalesce(a.region, s.region)""")
def sync_availability(t):
    snap = t.availability_snapshot.filter("snapshot_no = 2").drop("snapshot_no")
    return I.sync_availability(t.availability, snap, snap.select("title_id", "region"), AS_OF)


@query("rekey_show_ids", """
    SELECT CASE WHEN x.entity_type = 'title' AND x.source LIKE 'tmdb%' AND p.p_size > 25 THEN 'tmdb_tv' WHEN x.source = 'tmdb_tv' THEN 'tmdb' ELSE x.source END AS source,
           x.source_id, x.entity_type, x.entity_id FROM {external_id} x LEFT JOIN part p ON p.p_partkey = x.entity_id AND x.entity_type = 'title'""")
def rekey_show_ids(t):
    flat = t.external_id.withColumn("source", F.when(c("source") == "tmdb_tv", "tmdb").otherwise(c("source"))).drop("is_primary")
    return I.rekey_show_ids(flat, t.title)


# the later of two titles of one name and brand is merged into the earlier

def merge_map(t):
    return t.edge_derived.select(c("object_id").alias("merged_id"), c("subject_id").alias("surviving_id"))


_CLOSED = "cm AS (SELECT p_partkey AS merged_id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS surviving_id FROM part)"


@query("close_merges", f"WITH {_CLOSED} SELECT * FROM cm WHERE merged_id <> surviving_id")
def close_merges(t):
    return M.close_merges(merge_map(t))


@query("apply_merges", f"""WITH {_CLOSED} SELECT c.id, c.person_id, coalesce(m.surviving_id, c.title_id) AS title_id, c.predicate FROM {{credit}} c LEFT JOIN cm m ON m.merged_id = c.title_id""")
def apply_merges(t):
    return M.apply_merges(t, merge_map(t)).credit.select("id", "person_id", "title_id", "predicate")


@query("collapse_edges", f"""WITH {_CLOSED}, e AS (SELECT e.*, m.surviving_id AS s, m.surviving_id <> e.subject_id AS moved FROM {{edge}} e JOIN cm m ON m.merged_id = e.subject_id)
    SELECT id, subject_type, subject_id, predicate, object_type, object_id FROM (
        SELECT *, row_number() OVER (PARTITION BY s, predicate, object_type, object_id ORDER BY moved, id) AS rn FROM e) x WHERE rn > 1""")
def collapse_edges(t):
    return M.collapse_edges(t.edge, M.close_merges(merge_map(t)))


@query("titles_csv", """
    SELECT u.account_id, u.title_id, t.title AS "Title", CAST(t.release_year AS VARCHAR) AS "Year", CAST(u.rating AS VARCHAR) AS "Rating", CAST(u.last_watched_on AS VARCHAR) AS "WatchedDate",
           CASE WHEN u.view_count > 1 THEN 'true' ELSE 'false' END AS "Rewatch", n.note AS "Review", u.status AS "Status", CASE WHEN u.is_favorite THEN 'true' ELSE 'false' END AS "Favorite",
           u.kind AS "Kind", CAST(u.view_count AS VARCHAR) AS "Views", CAST(u.episodes_watched AS VARCHAR) AS "EpisodesWatched", strftime(u.added_at, '%Y-%m-%d') AS "AddedDate", t.tmdb_id AS "TMDbID"
    FROM {o_user_title} u JOIN {o_title_view} t ON t.id = u.title_id
    LEFT JOIN (SELECT account_id, title_id, first(note ORDER BY watched_on DESC NULLS LAST, id DESC) AS note FROM {viewing} GROUP BY 1, 2) n
         ON n.account_id = u.account_id AND n.title_id = u.title_id""")
def titles_csv(t):
    return X.titles_csv(t, t.account.select(c("id").alias("account_id")), AS_OF)
