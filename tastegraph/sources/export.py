"""Account exports: JSON sets and a CSV other trackers can import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf
from tastegraph.operators.views import title_view, user_title
from tastegraph.tables import Tables

# Header of the CSV export, in order.
CSV_COLUMNS = (
    "Title", "Year", "Rating", "WatchedDate", "Rewatch", "Review", "Status", "Favorite", "Kind", "Views",
    "EpisodesWatched", "AddedDate", "TMDbID",
)


def _mine(df: DataFrame, account_ids: DataFrame) -> DataFrame:
    return df.join(account_ids.select("account_id").distinct(), "account_id", "left_semi")


def export_sets(t: Tables, account_ids: DataFrame, as_of: AsOf) -> dict[str, DataFrame]:
    """The account-scoped result sets, each with its ``account_id``; sets the bundle lacks are left out."""
    title = t.title.select(F.col("id").alias("title_id"), "title")
    mine = lambda df: _mine(df, account_ids)
    view = title_view(t).select(F.col("id").alias("title_id"), "title", F.col("release_year").alias("year"), "tmdb_id")
    sets = {
        "account": t.account.withColumnRenamed("id", "account_id").join(account_ids.distinct(), "account_id", "left_semi").select(
            "account_id", "display_name", "created_at"),
        "titles": mine(user_title(t, as_of)).join(view, "title_id").select(
            "account_id", "title", "year", "tmdb_id", "kind", "status", "rating", "is_favorite", "added_at",
            "first_watched_on", "last_watched_on", "view_count", "episodes_watched"),
        "viewings": mine(t.viewing).join(title, "title_id").select("account_id", "title", "watched_on", "date_precision", "note"),
        "episodes": mine(t.episode_progress).join(
            t.episode.select(F.col("id").alias("episode_id"), "season_id", "episode_number"), "episode_id").join(
            t.season.select(F.col("id").alias("season_id"), "season_number"), "season_id").join(title, "title_id").select(
            "account_id", "title", F.col("season_number").alias("season"), F.col("episode_number").alias("episode"), "watched_at"),
        "ratings": mine(t.rating).join(title, "title_id").select("account_id", "title", "value", "rated_at", "superseded_at"),
        "shares": mine(t.share).join(title, "title_id").select("account_id", "slug", "title", "created_at", "revoked_at"),
    }
    if "state_event" in t:
        sets["state_events"] = mine(t.state_event).join(title, "title_id").select(
            "account_id", "title", "from_status", "to_status", "occurred_at")
    if "note" in t:
        sets["notes"] = mine(t.note).select("account_id", "body", "created_at")
    return sets


def export_json(t: Tables, account_ids: DataFrame, path: str, as_of: AsOf, buckets: int = 64) -> None:
    """Write every set as JSON lines, accounts dealt to a fixed number of folders by a hash and named in every line."""
    for name, rows in export_sets(t, account_ids, as_of).items():
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("account_id"), F.lit(buckets)).cast("int"))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(f"{path}/{name}")


def _field(col: Column) -> Column:
    """One CSV field: text, with lists joined."""
    return col.cast("string")


def titles_csv(t: Tables, account_ids: DataFrame, as_of: AsOf) -> DataFrame:
    """The CSV rows per account, every field as text. Ratings are on the 0.5 to 5 scale."""
    note = t.viewing.filter(F.col("note").isNotNull() & (F.col("note") != "")).groupBy("account_id", "title_id").agg(
        F.max_by("note", F.struct(F.coalesce("watched_on", F.lit("0001-01-01").cast("date")), F.col("id"))).alias("review"))
    view = title_view(t).select(F.col("id").alias("title_id"), "title", "release_year", "tmdb_id")
    rows = _mine(user_title(t, as_of), account_ids).join(view, "title_id").join(note, ["account_id", "title_id"], "left")
    c = F.col
    values = (
        c("title"), c("release_year"), c("rating"), c("last_watched_on"), c("view_count") > 1, c("review"), c("status"),
        c("is_favorite"), c("kind"), c("view_count"), c("episodes_watched"), F.date_format("added_at", "yyyy-MM-dd"), c("tmdb_id"),
    )
    return rows.select("account_id", "title_id", *[_field(v).alias(n) for n, v in zip(CSV_COLUMNS, values)])


def csv_line(values: list[Column]) -> Column:
    """One line of quoted fields, empty for NULL; what a value holds, line breaks too, is kept as it is."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for v in values]
    return F.concat_ws(",", *quoted)


def write_titles_csv(rows: DataFrame, path: str) -> None:
    """The rows of ``titles_csv`` as lines that end in CRLF, titles in order, one folder per account whose files follow each other by name.

    The header stands in front of an account's first line. Lines are written as text: Spark's CSV writer turns line breaks inside a
    value into line ends.
    """
    heads = rows.select("account_id").distinct().select(
        "account_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("Title"), F.lit(None).cast(dict(rows.dtypes)["title_id"]).alias("title_id"),
        csv_line([F.lit(c) for c in CSV_COLUMNS]).alias("value"))
    lines = rows.select("account_id", F.lit(1).alias("place"), "Title", "title_id",
                        csv_line([F.col(c) for c in CSV_COLUMNS]).alias("value"))
    order = ["account_id", "place", "Title", "title_id"]
    heads.unionByName(lines).repartitionByRange(*order).sortWithinPartitions(*order).select("account_id", "value").write.mode("overwrite").partitionBy(
        "account_id").option("lineSep", "\r\n").text(path)
