"""Merges with their log and their way back, and the side outputs of event folds."""

from pyspark.sql import functions as F

from tastegraph.demo.catalog.flow import _CLOSED, merge_map
from tastegraph.demo.model import AS_OF
from tastegraph.demo.registry import query
from tastegraph.operators import events as V
from tastegraph.operators import merge as M

c = F.col
# edges as the merges leave them: an edge that would repeat another of its survivor is gone
_EDGES = f"""{_CLOSED},
    pointed AS (SELECT e.*, coalesce(m.surviving_id, e.subject_id) AS owner, coalesce(m.surviving_id <> e.subject_id, false) AS moved
                FROM {{edge}} e LEFT JOIN cm m ON m.merged_id = e.subject_id),
    kept AS (SELECT *, row_number() OVER (PARTITION BY owner, predicate, object_type, object_id ORDER BY moved, id) = 1 AS stays FROM pointed)"""


def _rows(t, *parts):
    """(what, id, owner) of several tables."""
    frames = [getattr(t, name).select(F.lit(name).alias("what"), c(key).cast("string").alias("id"), c(owner).cast("string").alias("owner")) for name, key, owner in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


_TABLES = (("credit", "id", "title_id"), ("edge", "id", "subject_id"), ("season", "id", "title_id"), ("episode", "id", "title_id"), ("title", "id", "id"))


@query("apply_merges_tables", f"""
    WITH {_EDGES}
    SELECT 'credit' AS what, CAST(c.id AS VARCHAR) AS id, CAST(coalesce(surviving_id, title_id) AS VARCHAR) AS owner FROM {{credit}} c LEFT JOIN cm ON merged_id = title_id
    UNION ALL SELECT 'edge', CAST(id AS VARCHAR), CAST(owner AS VARCHAR) FROM kept WHERE stays OR NOT moved
    UNION ALL SELECT 'season', CAST(s.id AS VARCHAR), CAST(coalesce(surviving_id, title_id) AS VARCHAR) FROM {{season}} s LEFT JOIN cm ON merged_id = title_id
    UNION ALL SELECT 'episode', CAST(e.id AS VARCHAR), CAST(coalesce(surviving_id, title_id) AS VARCHAR) FROM {{episode}} e LEFT JOIN cm ON merged_id = title_id
    UNION ALL SELECT 'title', CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM {{title}} JOIN cm ON merged_id = id WHERE merged_id = surviving_id
    UNION ALL SELECT 'external_id', source || ':' || source_id, CAST(CASE WHEN entity_type = 'title' THEN coalesce(surviving_id, entity_id) ELSE entity_id END AS VARCHAR)
    FROM {{external_id}} LEFT JOIN cm ON merged_id = entity_id AND entity_type = 'title'
    UNION ALL SELECT 'entity_alias', title, CAST(surviving_id AS VARCHAR) FROM {{title}} JOIN cm ON merged_id = id WHERE merged_id <> surviving_id""")
def apply_merges_tables(t):
    after = M.apply_merges(t, merge_map(t))
    after = after.replace(external_id=after.external_id.withColumn("__key", F.concat_ws(":", "source", "source_id")))
    return _rows(after, *_TABLES, ("external_id", "__key", "entity_id"), ("entity_alias", "alias", "entity_id"))


@query("merge_log", f"""
    WITH {_EDGES},
    moved AS (SELECT merged_id, count(*) AS n FROM (
        SELECT title_id AS merged_id FROM {{credit}} UNION ALL SELECT subject_id FROM kept WHERE moved AND stays) x JOIN cm USING (merged_id)
        WHERE merged_id <> surviving_id GROUP BY 1),
    gone AS (SELECT subject_id AS merged_id, count(*) AS n FROM kept WHERE moved AND NOT stays GROUP BY 1)
    SELECT merged_id, surviving_id, t.title AS display_name, coalesce(moved.n, 0) AS repointed, coalesce(gone.n, 0) AS collapsed
    FROM cm JOIN {{title}} t ON t.id = merged_id LEFT JOIN moved USING (merged_id) LEFT JOIN gone USING (merged_id) WHERE merged_id <> surviving_id""")
def merge_log(t):
    return M.merge_log(t, merge_map(t), AS_OF).select("merged_id", "surviving_id", "display_name", "repointed", "collapsed")


@query("revert_merges", f"""
    WITH {_EDGES}
    SELECT 'credit' AS what, CAST(id AS VARCHAR) AS id, CAST(title_id AS VARCHAR) AS owner FROM {{credit}}
    UNION ALL SELECT 'edge', CAST(id AS VARCHAR), CAST(subject_id AS VARCHAR) FROM kept WHERE stays OR NOT moved
    UNION ALL SELECT 'season', CAST(id AS VARCHAR), CAST(title_id AS VARCHAR) FROM {{season}} UNION ALL SELECT 'episode', CAST(id AS VARCHAR), CAST(title_id AS VARCHAR) FROM {{episode}}
    UNION ALL SELECT 'title', CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM {{title}}""")
def revert_merges(t):
    """There and back: all as before, but for the edges that collapsed."""
    closed = merge_map(t)
    log, moves = M.merge_log(t, closed, AS_OF), M.merge_moves(t, closed)
    back, _ = M.revert_merges(M.apply_merges(t, closed), log, moves, closed.select("merged_id"), AS_OF)
    return _rows(back, *_TABLES)


@query("favorites_state", """
    WITH f AS (SELECT account_id, title_id, count(*) % 2 = 1 AS fav, max(occurred_at) AS last, min(occurred_at) AS first FROM {status_intent} GROUP BY 1, 2)
    SELECT account_id, title_id, ifnull(s.status, 'watchlist') AS status, ifnull(s.added_at, f.first) AS added_at, ifnull(f.fav, false) AS is_favorite,
           CASE WHEN f.fav THEN f.last END AS favorited_at
    FROM (FROM {title_state} WHERE status <> 'dropped') s FULL JOIN f USING (account_id, title_id)""")
def favorites_state(t):
    # dropped titles count as never tracked, so their favourites open a watchlist row
    return V.favorites_state(t.title_state.filter("status <> 'dropped'"), V.fold_favorites(t.status_intent)).select(
        "account_id", "title_id", "status", "added_at", "is_favorite", "favorited_at")


def _watched(t):
    batch = t.line.filter("flag = 'A'").select(
        (c("orderkey") * 10 + c("lineno")).alias("event_id"), "account_id", "title_id", c("odate").alias("occurred_at"), (c("qty") / 10).alias("stars"),
        F.lit(None).cast("date").alias("watched_on"), F.lit("day").alias("date_precision"))
    return V.apply_watch_events(batch, t)


_BATCH = "b AS (SELECT orderkey * 10 + lineno AS event_id, account_id, title_id, odate AS seen_at FROM {line} WHERE flag = 'A')"


@query("watch_transitions", f"""
    WITH {_BATCH} SELECT first(event_id ORDER BY seen_at, event_id) AS event_id, account_id, title_id, min(seen_at) AS occurred_at, any_value(s.status) AS from_status, 'watched' AS to_status
    FROM b LEFT JOIN {{title_state}} s USING (account_id, title_id) WHERE s.status IS DISTINCT FROM 'watched' GROUP BY account_id, title_id""")
def watch_transitions(t):
    return _watched(t)["state_event"].drop("event_kind")


@query("watch_viewings", f"""
    WITH {_BATCH} SELECT event_id AS id, account_id, title_id, CAST(seen_at AS DATE) AS watched_on,
           row_number() OVER (PARTITION BY account_id, title_id ORDER BY seen_at, event_id) > 1
           OR (account_id, title_id) IN (SELECT (account_id, title_id) FROM {{viewing}} WHERE episode_id IS NULL) AS is_rewatch FROM b""")
def watch_viewings(t):
    return _watched(t)["viewing"].select("id", "account_id", "title_id", "watched_on", "is_rewatch")


@query("erased_tables", """
    WITH gone AS (SELECT id FROM {account} WHERE deleted_at IS NOT NULL)
    SELECT 'account' AS entity, count(*) AS kept FROM {account} WHERE id NOT IN (FROM gone) UNION ALL SELECT 'rating', count(*) FROM {rating} WHERE account_id NOT IN (FROM gone)
    UNION ALL SELECT 'title_state', count(*) FROM {title_state} WHERE account_id NOT IN (FROM gone) UNION ALL SELECT 'viewing', count(*) FROM {viewing} WHERE account_id NOT IN (FROM gone)
    UNION ALL SELECT 'share', count(*) FROM {share} WHERE account_id NOT IN (FROM gone)
    UNION ALL SELECT 'episode_progress', count(*) FROM {episode_progress} WHERE account_id NOT IN (FROM gone)""")
def erased_tables(t):
    left, _ = V.erase_accounts(t, t.account.filter("deleted_at IS NOT NULL").select(c("id").alias("account_id")))
    out = None
    for name in ("account", "rating", "title_state", "viewing", "share", "episode_progress"):
        one = getattr(left, name).agg(F.count("*").alias("kept")).select(F.lit(name).alias("entity"), "kept")
        out = one if out is None else out.unionByName(one)
    return out
