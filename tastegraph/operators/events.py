"""Folds over event logs. Every fold is a group aggregate or a sliced window, so one busy key is
spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, micros, stars_to_value, timestamp, tuple_le
from tastegraph.functions.text import is_bot
from tastegraph.plans.slices import time_slice, with_last_seen, with_next, with_previous, with_rank
from tastegraph.tables import Tables

KEY = ["account_id", "title_id"]
DAY = 86_400
REMOVED = "removed"
STARTED = ("watching", "watched")
# An account's tables in the order they are erased, and its column there.
ACCOUNT_TABLES = (
    ("share", "account_id"), ("note", "account_id"), ("rating", "account_id"), ("episode_progress", "account_id"),
    ("viewing", "account_id"), ("state_event", "account_id"), ("title_state", "account_id"),
)
ACCOUNT_LAST = (("auth_session", "user_id", "session"), ("oauth_account", "user_id", "oauth_account"), ("account", "id", "account"))
INVITE_COLUMNS = (("created_by", "invite_created"), ("redeemed_by", "invite_redeemed"))


def _when() -> Column:
    return F.struct("occurred_at", "event_id")


def _summary(events: DataFrame) -> DataFrame:
    """One row per title and account: latest status and first times; also runs on a stream.

    ``events`` has account_id, title_id, event_id, occurred_at, status.
    """
    s = F.col("status")
    return events.groupBy(*KEY).agg(
        F.max_by("status", _when()).alias("status"),
        F.min("occurred_at").alias("added_at"),
        F.min(F.when(s.isin(*STARTED), F.col("occurred_at"))).alias("started_at"),
        F.min(F.when(s == "watched", F.col("occurred_at"))).alias("completed_at"),
        F.max("occurred_at").alias("updated_at"),
    )


def remove_titles(events: DataFrame) -> DataFrame:
    """The events that still count: those after the last removal of their title. The log keeps all."""
    gone = events.filter(F.col("status") == REMOVED).groupBy(*KEY).agg(F.max(_when()).alias("gone"))
    return events.join(gone, KEY, "left").filter(F.col("gone").isNull() | (_when() > F.col("gone"))).drop("gone")


def fold_status(events: DataFrame) -> DataFrame:
    """Standing state from status events. ``started_at`` and ``completed_at`` are firsts and never move."""
    return _summary(remove_titles(events))


def status_transitions(events: DataFrame, slice_seconds: int = 30 * DAY) -> DataFrame:
    """The transitions worth logging: a status set again is none; a removed title starts afresh."""
    order = [F.col("occurred_at"), F.col("event_id")]
    seen = with_previous(events, KEY, time_slice(F.col("occurred_at"), slice_seconds), order, F.col("status"), "before")
    before = F.when(F.col("before") != REMOVED, F.col("before"))
    changed = seen.withColumn("from_status", before).filter(
        (F.col("status") != REMOVED) & ~F.col("from_status").eqNullSafe(F.col("status")))
    return changed.select(*KEY, "event_id", "occurred_at", F.lit("status_change").alias("event_kind"), "from_status",
                          F.col("status").alias("to_status"))


def fold_favorites(toggles: DataFrame) -> DataFrame:
    """Favourite flag after all toggles; an odd number leaves it on since the last one."""
    return toggles.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("occurred_at").alias("last"), F.min("occurred_at").alias("first")).select(
        *KEY, (F.col("n") % 2 == 1).alias("is_favorite"), F.when(F.col("n") % 2 == 1, F.col("last")).alias("favorited_at"),
        F.col("first").alias("first_toggled_at"))


def favorites_state(state: DataFrame, favorites: DataFrame) -> DataFrame:
    """State with favourites applied; a favourite that was never tracked gets a watchlist row."""
    s = state.select(*KEY, "status", "added_at")
    return s.join(favorites, KEY, "full").select(
        *KEY, F.coalesce("status", F.lit("watchlist")).alias("status"),
        F.coalesce("added_at", "first_toggled_at").alias("added_at"),
        F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"), "favorited_at")


def rating_history(events: DataFrame, slice_seconds: int = 365 * DAY) -> DataFrame:
    """Ratings with when each was superseded; a clearing event (NULL value) ends one without a new row."""
    order = [F.col("occurred_at"), F.col("event_id")]
    ended = with_next(events, KEY, time_slice(F.col("occurred_at"), slice_seconds), order, F.col("occurred_at"), "superseded_at")
    return ended.filter(F.col("value").isNotNull()).select(
        F.col("event_id").alias("id"), *KEY, "value", F.col("occurred_at").alias("rated_at"), "superseded_at")


def stamp_rewatch(viewings: DataFrame) -> DataFrame:
    """Viewings with whether an earlier title-level viewing exists."""
    at = F.struct("created_at", "id")
    first = viewings.filter(F.col("episode_id").isNull()).groupBy(*KEY).agg(F.min(at).alias("first"))
    return viewings.join(first, KEY, "left").withColumn(
        "is_rewatch", F.coalesce(F.col("first") < at, F.lit(False))).drop("first")


def apply_watch_events(batch: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """What marking titles watched writes: states, transitions, viewings and ratings.

    ``batch`` has event_id, account_id, title_id, occurred_at, stars, watched_on, date_precision.
    """
    state = t.title_state.select(*KEY, F.col("status").alias("from_status"), F.col("added_at").alias("was_added"),
                                 F.col("started_at").alias("was_started"), F.col("completed_at").alias("was_completed"))
    per_key = batch.groupBy(*KEY).agg(
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("updated_at"), F.min_by("event_id", _when()).alias("event_id"))
    met = per_key.join(state, KEY, "left")
    states = met.select(
        *KEY, F.lit("watched").alias("status"), F.coalesce("was_added", "first_at").alias("added_at"),
        F.coalesce("was_started", "first_at").alias("started_at"), F.coalesce("was_completed", "first_at").alias("completed_at"), "updated_at")
    transitions = met.filter(~F.col("from_status").eqNullSafe("watched")).select(
        "event_id", *KEY, F.col("first_at").alias("occurred_at"), F.lit("status_change").alias("event_kind"), "from_status",
        F.lit("watched").alias("to_status"))
    precision = F.coalesce("date_precision", F.lit("day"))
    new = batch.select(
        F.col("event_id").alias("id"), *KEY,
        F.when(precision != "unknown", F.coalesce("watched_on", F.col("occurred_at").cast("date"))).alias("watched_on"),
        precision.alias("date_precision"), F.col("occurred_at").alias("created_at"))
    before = t.viewing.filter(F.col("episode_id").isNull()).select(*KEY).distinct().withColumn("seen", F.lit(True))
    first = batch.groupBy(*KEY).agg(F.min(_when()).alias("first"))
    viewings = new.join(before, KEY, "left").join(first, KEY).withColumn(
        "is_rewatch", F.coalesce("seen", F.lit(False)) | (F.struct(F.col("created_at").alias("occurred_at"), F.col("id").alias("event_id")) > F.col("first"))
    ).drop("seen", "first")
    rated = batch.filter(F.col("stars").isNotNull()).select(
        "event_id", *KEY, "occurred_at", stars_to_value(F.col("stars")).alias("value"))
    return {"title_state": states, "state_event": transitions, "viewing": viewings, "rating": rating_history(rated)}


def expand_progress(events: DataFrame, episode_view: DataFrame) -> DataFrame:
    """Episode progress from "I am here" events.

    ``events`` has event_id, account_id, title_id, occurred_at, action (through, season, unseason),
    episode_id for through and season_number for the others. Only aired episodes are ever marked.
    """
    ep = episode_view.select(F.col("id").alias("episode_id"), "title_id", "season_number", "episode_number", "has_aired")
    cols = ["account_id", "title_id", "episode_id", "occurred_at", "event_id"]
    target = ep.select("episode_id", F.col("season_number").alias("to_season"), F.col("episode_number").alias("to_episode"))
    season = events.filter(F.col("action").isin("season", "unseason")).drop("episode_id")
    taken_back = season.filter(F.col("action") == "unseason").select(*KEY).distinct()
    reach = events.filter(F.col("action") == "through").join(target, "episode_id").select(
        "account_id", "title_id", "occurred_at", "event_id", "to_season", "to_episode")
    # an episode counts from the first event that reaches it, so where nothing is taken back one event per place is enough
    first = reach.join(taken_back, KEY, "left_anti").groupBy(*KEY, "to_season", "to_episode").agg(F.min(_when()).alias("w")).select(
        *KEY, "w.occurred_at", "w.event_id", "to_season", "to_episode")
    through = first.unionByName(reach.join(taken_back, KEY, "left_semi")).join(ep.filter("has_aired"), "title_id").filter(
        tuple_le([F.col("season_number"), F.col("episode_number")], [F.col("to_season"), F.col("to_episode")]))
    marked = season.filter(F.col("action") == "season").join(ep.filter("has_aired"), ["title_id", "season_number"])
    unmarked = season.filter(F.col("action") == "unseason").join(ep, ["title_id", "season_number"])
    marks = through.select(*cols).unionByName(marked.select(*cols))
    undone = unmarked.groupBy("account_id", "episode_id").agg(F.max(_when()).alias("undone"))
    standing = marks.join(undone, ["account_id", "episode_id"], "left").filter(
        F.col("undone").isNull() | (_when() > F.col("undone")))
    return standing.groupBy("account_id", "title_id", "episode_id").agg(F.min("occurred_at").alias("watched_at"))


def progress_effects(progress: DataFrame, episode_view: DataFrame, title_state: DataFrame) -> DataFrame:
    """Per account and title: watched and aired counts, whether progress starts or completes the show."""
    watched = progress.groupBy(*KEY).agg(F.count("*").alias("watched"))
    aired = episode_view.groupBy("title_id").agg(F.count_if("has_aired").alias("aired"))
    state = title_state.select(*KEY, F.col("status").alias("from_status"))
    rows = watched.join(aired, "title_id", "left").join(state, KEY, "left").withColumn("aired", F.coalesce("aired", F.lit(0)))
    running = F.coalesce(F.col("from_status").isin(*STARTED), F.lit(False))
    return rows.select(
        *KEY, "watched", "aired", "from_status", ((F.col("watched") > 0) & ~running).alias("starts"),
        ((F.col("aired") > 0) & (F.col("watched") >= F.col("aired")) & ~F.col("from_status").eqNullSafe("watched")).alias("just_completed"))


def sliding_limit(hits: DataFrame, limit: int, window_seconds: int, carried: DataFrame | None = None) -> DataFrame:
    """Two-counter sliding-window limiter over (bucket, hit_id, ts).

    A hit's estimate is its place in the current window plus the previous window's count, weighted by
    how much of that window is still in view. Denied hits count too. ``carried`` holds counts
    (bucket, window_no, hits) from before these rows.
    """
    number = F.floor(micros(F.col("ts")) / (window_seconds * 1_000_000))
    h = hits.withColumn("window_no", number)
    piece = max(1, window_seconds // 24)
    placed = with_rank(h, ["bucket", "window_no"], time_slice(F.col("ts"), piece), [F.col("ts"), F.col("hit_id")], "place")
    counts = h.groupBy("bucket", "window_no").agg(F.count("*").alias("hits"))
    if carried is not None:
        counts = counts.unionByName(carried.select("bucket", "window_no", "hits")).groupBy("bucket", "window_no").agg(F.sum("hits").alias("hits"))
        earlier = carried.select("bucket", "window_no", F.col("hits").alias("already"))
        placed = placed.join(earlier, ["bucket", "window_no"], "left").withColumn(
            "place", F.col("place") + F.coalesce("already", F.lit(0))).drop("already")
    before = counts.select("bucket", (F.col("window_no") + 1).alias("window_no"), F.col("hits").alias("prev"))
    elapsed = micros(F.col("ts")) / (window_seconds * 1_000_000) - F.col("window_no")
    left = (F.col("window_no") + 1) * window_seconds - micros(F.col("ts")) / 1_000_000
    rows = placed.join(before, ["bucket", "window_no"], "left").withColumn(
        "estimate", F.coalesce("prev", F.lit(0)) * (1 - elapsed) + F.col("place"))
    return rows.select(
        "bucket", "hit_id", "ts", (F.col("estimate") <= limit).alias("allowed"),
        F.greatest(F.lit(0), limit - F.ceil("estimate")).cast("int").alias("remaining"),
        F.greatest(F.lit(1), F.ceil(left)).cast("int").alias("retry_after_s"))


def window_counts(hits: DataFrame, window_seconds: int) -> DataFrame:
    """Hits per bucket and window, as the limiter stores them."""
    number = F.floor(micros(F.col("ts")) / (window_seconds * 1_000_000))
    return hits.groupBy("bucket", number.alias("window_no")).agg(F.count("*").alias("hits"))


def _as_of(left: DataFrame, right: DataFrame, at: str, since: str, value: Column, name: str) -> DataFrame:
    """(slug, ``name``): the last ``right`` value of the same account and title at or before ``left``'s time.

    Both sides are laid on one time line per key and read along it, so a busy key is never paired with itself.
    """
    line = right.select(*KEY, F.lit(None).cast("string").alias("slug"), F.col(since).alias("__at"), F.lit(0).alias("__ask"),
                        F.col("id").alias("__tie"), value.alias("__held"))
    asks = left.select(*KEY, "slug", F.col(at).alias("__at"), F.lit(1).alias("__ask"),
                       F.lit(None).cast(dict(right.dtypes)["id"]).alias("__tie"))
    both = line.unionByName(asks, allowMissingColumns=True)
    order = [F.col("__at"), F.col("__ask"), F.col("__tie")]
    seen = with_last_seen(both, KEY, time_slice(F.col("__at"), 365 * DAY), order, F.col("__held"), name)
    return seen.filter("__ask = 1").select("slug", "__at", name)


def snapshot_shares(shares: DataFrame, ratings: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Shares with the rating (and public note) that stood when they were made."""
    r = _as_of(shares, ratings, "created_at", "rated_at", F.struct("value", "superseded_at"), "r")
    standing = F.col("r.superseded_at").isNull() | (F.col("r.superseded_at") > F.col("__at"))
    stood = r.filter(standing).select("slug", F.col("r.value").alias("rating"))
    out = shares.join(stood, "slug", "left").withColumn(
        "rating_snapshot", F.when(F.col("include_rating"), F.col("rating"))).drop("rating")
    if notes is None:
        return out
    n = _as_of(shares, notes.filter(~F.col("is_private")), "created_at", "created_at", F.col("body"), "note_snapshot")
    return out.join(n.select("slug", "note_snapshot"), "slug", "left")


def live_views(views: DataFrame, shares: DataFrame) -> DataFrame:
    """Views of live shares by people, one row each; also runs on a stream of views."""
    live = shares.select("slug", "revoked_at")
    return views.filter(~is_bot(F.col("user_agent"))).join(live, "slug").filter(
        F.col("revoked_at").isNull() | (F.col("ts") < F.col("revoked_at")))


def count_views(views: DataFrame, shares: DataFrame) -> DataFrame:
    """How often people viewed each live share."""
    return live_views(views, shares).groupBy("slug").agg(F.count("*").alias("view_count"))


def erase_accounts(t: Tables, account_ids: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables without the accounts' rows, and a receipt (account_id, entity, rows_deleted).

    Invites are released, not deleted. A table the bundle lacks is skipped.
    """
    ids = account_ids.select(F.col("account_id").alias("__account")).distinct()
    frames, receipts = {}, []

    def receipt(df: DataFrame, column: str, entity: str) -> None:
        receipts.append(df.select(F.col(column).alias("__account")).join(ids, "__account").groupBy("__account").agg(
            F.count("*").alias("rows_deleted")).select(F.col("__account").alias("account_id"), F.lit(entity).alias("entity"), "rows_deleted"))

    plain = [(name, column, name) for name, column in ACCOUNT_TABLES] + list(ACCOUNT_LAST)
    for name, column, entity in plain:
        if _held(t, name):
            df = getattr(t, name)
            frames[name] = df.join(ids.withColumnRenamed("__account", column), column, "left_anti").select(*df.columns)
            receipt(df, column, entity)
    if _held(t, "invite"):
        invite = t.invite
        flag = ids.withColumn("__gone", F.lit(True))
        for column, entity in INVITE_COLUMNS:
            receipt(invite, column, entity)
            invite = invite.join(flag.withColumnRenamed("__account", column), column, "left").withColumn(
                column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone").select(*t.invite.columns)
        frames["invite"] = invite
    out = receipts[0]
    for frame in receipts[1:]:
        out = out.unionByName(frame)
    return t.replace(**frames), out


def _held(t: Tables, name: str) -> bool:
    try:
        getattr(t, name)
    except AttributeError:
        return False
    return True


def expire(as_of: AsOf, ts: Column, days: int) -> Column:
    """True for rows older than a number of days."""
    return ts < timestamp(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


