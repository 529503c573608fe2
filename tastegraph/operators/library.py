"""An account's library: lists, rails, counts, seasons, shares; for all accounts at once.

``title`` is the title view (with year and genres).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, timestamp
from tastegraph.operators.views import availability_current, episode_view, season_view, title_view, top_rows, user_title
from tastegraph.tables import Tables

# Offers that count as streamable.
STREAMABLE = ("flatrate", "free", "ads")


def _shown(title: DataFrame) -> DataFrame:
    return title.select(F.col("id").alias("title_id"), "slug", "title", "release_date", "release_year", "poster_path",
                        "runtime_minutes", "genres")


def _filtered(user_title: DataFrame, filters: dict | None) -> DataFrame:
    f = filters or {}
    out = user_title
    if f.get("status"):
        out = out.filter(F.col("status") == f["status"])
    if f.get("favorites_only"):
        out = out.filter("is_favorite")
    if f.get("kind"):
        out = out.filter(F.col("kind") == f["kind"])
    if f.get("genre"):
        out = out.filter(F.array_contains("genres", f["genre"]))
    return out


def list_library(t: Tables, as_of: AsOf, filters: dict | None = None, sort: str = "added", k: int = 200,
                 region: str = "US") -> DataFrame:
    """The first k titles of each account's library under filters, in one of six orders."""
    c = F.col
    orders: dict[str, list[Column]] = {
        "added": [c("added_at").desc()],
        "rating": [c("rating").desc_nulls_last(), c("added_at").desc()],
        "title": [c("title")],
        "release": [c("release_date").desc_nulls_last()],
        "runtime": [c("runtime_minutes").asc_nulls_last()],
        "streaming": [F.coalesce("streamable", F.lit(False)).desc(), c("added_at").desc()],
    }
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}")
    rows = _filtered(user_title(t, as_of).join(_shown(title_view(t)), "title_id"), filters)
    if sort == "streaming":
        offers = availability_current(t, as_of).filter(
            (c("region") == region.upper()) & c("offer_type").isin(*STREAMABLE))
        rows = rows.join(offers.select("title_id").distinct().withColumn("streamable", F.lit(True)), "title_id", "left")
    return top_rows(rows, ["account_id"], [*orders[sort], c("title_id")], k)


def continue_watching(user_title: DataFrame, title: DataFrame, k: int = 12) -> DataFrame:
    """Titles in progress with an episode left, last touched first."""
    going = user_title.filter((F.col("status") == "watching") & F.col("next_episode_id").isNotNull())
    order = [F.col("updated_at").desc(), F.col("added_at").desc(), F.col("title_id")]
    return top_rows(going, ["account_id"], order, k).join(_shown(title), "title_id")


def recently_watched(user_title: DataFrame, title: DataFrame, k: int = 12) -> DataFrame:
    """Watched titles, last seen first."""
    when = F.coalesce("last_watched_on", F.col("completed_at").cast("date"))
    seen = user_title.filter(F.col("status") == "watched").withColumn("seen_on", when)
    return top_rows(seen, ["account_id"], [F.col("seen_on").desc_nulls_last(), F.col("title_id")], k).join(
        _shown(title), "title_id")


def library_genres(user_title: DataFrame, title: DataFrame, filters: dict | None = None) -> DataFrame:
    """Genres present in each account's library under filters, with counts."""
    rows = _filtered(user_title.join(_shown(title), "title_id"), filters)
    return rows.select("account_id", F.explode("genres").alias("genre")).groupBy("account_id", "genre").agg(
        F.count("*").alias("n"))


def library_kinds(user_title: DataFrame, title: DataFrame, filters: dict | None = None) -> DataFrame:
    """Movies and shows in each account's library under filters."""
    rows = _filtered(user_title.join(_shown(title), "title_id"), filters)
    return rows.groupBy("account_id", "kind").agg(F.count("*").alias("n"))


def library_counts(user_title: DataFrame) -> DataFrame:
    """Four segment sizes per account in one pass."""
    s = F.col("status")
    return user_title.groupBy("account_id").agg(
        F.count_if(s == "watchlist").alias("watchlist"), F.count_if(s == "watching").alias("watching"),
        F.count_if(s == "watched").alias("watched"), F.count_if("is_favorite").alias("favorites"))


def seasons_with_progress(t: Tables, as_of: AsOf) -> DataFrame:
    """Non-empty seasons of every tracked title with episodes held, aired and watched per account."""
    seasons = season_view(t, as_of).filter("episode_count > 0").withColumnRenamed("id", "season_id")
    episode = t.episode.select(F.col("id").alias("episode_id"), "season_id")
    seen = t.episode_progress.select("account_id", "episode_id").join(episode, "episode_id").groupBy(
        "account_id", "season_id").agg(F.count("*").alias("watched_count"))
    tracked = t.title_state.select("account_id", "title_id")
    return tracked.join(seasons, "title_id").join(seen, ["account_id", "season_id"], "left").fillna(0, ["watched_count"])


def episodes_with_watched(t: Tables, as_of: AsOf, wanted: DataFrame) -> DataFrame:
    """Episodes of the wanted (account_id, title_id, season_number) with whether they were watched."""
    e = episode_view(t, as_of).withColumnRenamed("id", "episode_id")
    seen = t.episode_progress.select("account_id", "episode_id").distinct().withColumn("watched", F.lit(True))
    return (
        wanted.distinct().join(e, ["title_id", "season_number"])
        .join(seen, ["account_id", "episode_id"], "left")
        .withColumn("watched", F.coalesce("watched", F.lit(False)))
    )


def account_activity(t: Tables, as_of: AsOf) -> DataFrame:
    """What each live account has done: titles watched, rated, episodes, last login, open sessions."""
    by = lambda df, key, *aggs: df.groupBy(F.col(key).alias("id")).agg(*aggs)
    watched = by(t.title_state.filter(F.col("status") == "watched"), "account_id", F.count("*").alias("watched"))
    rated = by(t.rating.filter(F.col("superseded_at").isNull()), "account_id", F.count("*").alias("rated"))
    episodes = by(t.episode_progress, "account_id", F.count("*").alias("episodes"))
    sessions = by(t.auth_session, "user_id", F.max("created_at").alias("last_login"),
                  F.count_if(F.col("expires_at") > timestamp(as_of)).alias("active_sessions"))
    out = t.account.filter(F.col("deleted_at").isNull())
    for frame in (watched, rated, episodes, sessions):
        out = out.join(frame, "id", "left")
    return out.fillna(0, ["watched", "rated", "episodes", "active_sessions"])


def live_shares(t: Tables, k: int = 50) -> DataFrame:
    """Each account's newest shares that were not revoked."""
    title = t.title.select(F.col("id").alias("title_id"), "title", F.col("slug").alias("title_slug"))
    live = t.share.filter(F.col("revoked_at").isNull()).join(title, "title_id")
    return top_rows(live, ["account_id"], [F.col("created_at").desc(), F.col("slug")], k)
