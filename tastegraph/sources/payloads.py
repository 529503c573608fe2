"""Landed provider payloads: keep the latest, parse loosely, set rejects aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, timestamp
from tastegraph.plans.folders import drop_folder, files, folders

# Offer types of a watch-provider payload, and how long payloads and counters are kept.
OFFER_TYPES = ("flatrate", "free", "ads", "rent", "buy")
PAYLOAD_DAYS = 90
COUNTER_DAYS = 1

_NAMED = "array<struct<id:bigint,name:string>>"
_COMPANY = "array<struct<id:bigint,name:string,logo_path:string,origin_country:string>>"
_KEYWORDS = f"struct<keywords:{_NAMED},results:{_NAMED}>"
_PERSON = "id:bigint,name:string,profile_path:string,known_for_department:string,gender:int,popularity:double"
_IDS = "struct<imdb_id:string,wikidata_id:string>"

MOVIE = (
    "id bigint, title string, original_title string, release_date string, runtime int, status string, overview string, "
    "original_language string, poster_path string, backdrop_path string, popularity double, vote_average double, "
    "vote_count bigint, budget bigint, revenue bigint, homepage string, adult boolean, imdb_id string, "
    f"genres {_NAMED}, belongs_to_collection struct<id:bigint,name:string,poster_path:string>, "
    f"production_companies {_COMPANY}, "
    f"credits struct<cast:array<struct<{_PERSON},character:string,credit_id:string,`order`:int>>,"
    f"crew:array<struct<{_PERSON},job:string,department:string,credit_id:string>>>, "
    f"keywords {_KEYWORDS}, external_ids {_IDS}")

SHOW = (
    "id bigint, name string, original_name string, first_air_date string, last_air_date string, episode_run_time array<int>, "
    "status string, overview string, original_language string, poster_path string, backdrop_path string, popularity double, "
    "vote_average double, vote_count bigint, homepage string, adult boolean, "
    f"genres {_NAMED}, networks {_COMPANY}, production_companies {_COMPANY}, "
    "seasons array<struct<id:bigint,season_number:int,name:string,overview:string,air_date:string,episode_count:int,poster_path:string>>, "
    f"aggregate_credits struct<cast:array<struct<{_PERSON},total_episode_count:int,`order`:int,"
    "roles:array<struct<character:string,credit_id:string>>>>,"
    f"crew:array<struct<{_PERSON},department:string,jobs:array<struct<job:string,credit_id:string,episode_count:int>>>>>, "
    f"keywords {_KEYWORDS}, external_ids {_IDS}")

PERSON = (
    "id bigint, name string, also_known_as array<string>, birthday string, deathday string, place_of_birth string, "
    "biography string, known_for_department string, gender int, profile_path string, popularity double, imdb_id string")

SEASON = (
    "id bigint, season_number int, name string, overview string, air_date string, poster_path string, "
    "episodes array<struct<id:bigint,episode_number:int,season_number:int,name:string,overview:string,air_date:string,runtime:int,still_path:string>>")

_OFFERS = "array<struct<provider_id:bigint,provider_name:string,logo_path:string,display_priority:int>>"
WATCH_PROVIDERS = (
    "id bigint, results map<string, struct<link:string," + ",".join(f"{o}:{_OFFERS}" for o in OFFER_TYPES) + ">>")

_CELL = "struct<value:string>"
BINDING_FIELDS = (
    "imdb", "basedOn", "basedOnLabel", "basedOnType", "author", "authorLabel", "series", "seriesLabel", "seriesType",
    "influencedBy",
)
BINDINGS = (
    "results struct<bindings:array<struct<" + ",".join(f"{f}:{_CELL}" for f in BINDING_FIELDS) + ">>>")

MOVIE_REQUIRED = ("id", "title")
SHOW_REQUIRED = ("id", "name")


def loose_date(col: Column) -> Column:
    """A date, or NULL for blank and malformed text."""
    return F.when(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def raw_capture(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest payload per (resource, source_id, variant); partial maxima before the shuffle."""
    key = ["resource", "source_id", "variant"]
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in key]
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", F.xxhash64("payload"))).alias("p"))
    return latest.select(*key, "p.*").select(*both.columns)


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(*[c for c in raw.columns if c != "payload"], F.from_json("payload", schema).alias("p"))


def parse_movie(raw: DataFrame) -> DataFrame:
    """Movies as nested records: loose NULLs and dates, absent lists empty."""
    m = _parsed(raw, MOVIE).select("source_id", "p.*")
    return _with_lists(m, ["genres", "production_companies"]).withColumns({
        "release_date": loose_date(F.col("release_date")), "adult": F.coalesce("adult", F.lit(False)),
        "imdb_id": F.coalesce("imdb_id", "external_ids.imdb_id")})


def parse_show(raw: DataFrame) -> DataFrame:
    """Shows as nested records with seasons, networks and crew jobs over the run."""
    s = _parsed(raw, SHOW).select("source_id", "p.*")
    return _with_lists(s, ["genres", "networks", "production_companies", "seasons", "episode_run_time"]).withColumns({
        "first_air_date": loose_date(F.col("first_air_date")), "last_air_date": loose_date(F.col("last_air_date")),
        "adult": F.coalesce("adult", F.lit(False)), "imdb_id": F.col("external_ids.imdb_id")})


def parse_person(raw: DataFrame) -> DataFrame:
    """Person details."""
    p = _parsed(raw, PERSON).select("source_id", "p.*")
    return _with_lists(p, ["also_known_as"]).withColumns(
        {"birthday": loose_date(F.col("birthday")), "deathday": loose_date(F.col("deathday"))})


def parse_season(raw: DataFrame) -> DataFrame:
    """One row per episode of a season payload; ``source_id`` is the show's."""
    s = _parsed(raw, SEASON).select("source_id", "p.season_number", F.explode("p.episodes").alias("e"))
    return s.select(
        "source_id", "season_number", F.col("e.episode_number").alias("episode_number"), "e.name", "e.overview",
        loose_date(F.col("e.air_date")).alias("air_date"), F.col("e.runtime").alias("runtime_minutes"), "e.still_path")


def parse_watch_providers(raw: DataFrame) -> DataFrame:
    """One row per offer: (source_id, region, offer_type, provider_id, provider_name, link)."""
    regions = _parsed(raw, WATCH_PROVIDERS).select("source_id", F.explode("p.results").alias("region", "r"))
    kinds = F.map_from_arrays(F.array(*[F.lit(o) for o in OFFER_TYPES]), F.array(*[F.col(f"r.{o}") for o in OFFER_TYPES]))
    offers = regions.select("source_id", "region", F.col("r.link").alias("link"), F.explode(kinds).alias("offer_type", "offers"))
    return offers.select("source_id", "region", "link", "offer_type", F.explode("offers").alias("o")).select(
        "source_id", "region", "offer_type", "o.provider_id", "o.provider_name", "link")


def offered_regions(raw: DataFrame) -> DataFrame:
    """(source_id, region) a watch-provider payload answers for, with offers or without."""
    return _parsed(raw, WATCH_PROVIDERS).select("source_id", F.explode("p.results").alias("region", "r")).select("source_id", "region")


def entity_key(uri: Column) -> Column:
    """Last part of an entity address."""
    return F.element_at(F.split(uri, "/"), -1)


def parse_bindings(raw: DataFrame) -> DataFrame:
    """Query result bindings as columns; addresses become ids."""
    b = _parsed(raw, BINDINGS).select(F.explode("p.results.bindings").alias("b"))
    v = lambda name: F.col(f"b.{name}.value")
    return b.select(
        v("imdb").alias("imdb_id"), entity_key(v("basedOn")).alias("based_on"), v("basedOnLabel").alias("based_on_label"),
        entity_key(v("basedOnType")).alias("based_on_type"), v("authorLabel").alias("author_label"),
        entity_key(v("series")).alias("series"), v("seriesLabel").alias("series_label"),
        entity_key(v("seriesType")).alias("series_type"), entity_key(v("influencedBy")).alias("influenced_by"))


def failing_paths(record: Column, path: str) -> Column:
    """Where a required path is NULL in a parsed record, as an array of text: ``credits.cast[].id`` gives ``credits.cast[3].id``.

    A list is looked into as far as it goes; an absent or empty one holds nothing that could fail, an absent record fails as a whole.
    """
    head, many, rest = path.partition("[].")
    steps = head.split(".")
    value = record
    for step in steps:
        value = value[step]
    if not many:
        return F.when(value.isNull(), F.array(F.lit(path))).otherwise(F.array().cast("array<string>"))
    inside = F.transform(value, lambda item, i: F.transform(
        failing_paths(item, rest), lambda p: F.concat(F.lit(f"{head}["), i.cast("string"), F.lit("]."), p)))
    return F.coalesce(F.flatten(inside), F.array().cast("array<string>"))


def split_rejects(raw: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Payloads that parse with their required fields, and the others with where they fail, joined by commas.

    ``required`` names fields of the schema at any depth, ``[]`` after a list's name standing for each of its items. Text that is no JSON
    fails at ``$``, as does a value of the wrong kind in a field that is not required.
    """
    p = raw.withColumn("p", F.from_json("payload", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    missing = F.flatten(F.array(*[failing_paths(F.col("p"), f) for f in required])) if required else F.array().cast("array<string>")
    broken = F.col("p").isNull() | F.expr("try_parse_json(payload)").isNull()
    path = F.when(broken, "$").when(F.size(missing) > 0, F.array_join(missing, ",")).when(F.col("p._corrupt_record").isNotNull(), "$")
    judged = p.withColumn("failed_at", path).drop("p")
    return judged.filter(F.col("failed_at").isNull()).drop("failed_at"), judged.filter(F.col("failed_at").isNotNull())


def prune_payloads(raw: DataFrame, as_of: AsOf, days: int = PAYLOAD_DAYS) -> DataFrame:
    """Payloads young enough to keep."""
    return raw.filter(F.col("fetched_at") >= timestamp(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def write_payloads(raw: DataFrame, path: str) -> None:
    """Add payloads to a table with one folder for each day they were fetched."""
    raw.withColumn("fetched_on", F.to_date("fetched_at")).repartition("fetched_on").write.mode("append").partitionBy("fetched_on").parquet(path)


def prune_payload_folders(spark: SparkSession, path: str, as_of: AsOf, days: int = PAYLOAD_DAYS) -> None:
    """Delete what is too old from a table of ``write_payloads``: whole days go with their folders, the day of the limit is rewritten, no other is touched."""
    limit = spark.range(1).select((timestamp(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")).alias("t")).select(
        F.to_date("t").cast("string").alias("day"), "t").first()
    for name in folders(spark, path):
        day = name.removeprefix("fetched_on=")
        if day < limit["day"]:
            drop_folder(spark, f"{path}/{name}")
        elif day == limit["day"]:
            # written beside the table first, so that the day is never without its rows
            old, new = f"{path}/{name}", f"{path}/_young-{day}"
            spark.read.parquet(old).filter(F.col("fetched_at") >= F.lit(limit["t"])).write.mode("overwrite").parquet(new)
            drop_folder(spark, old)
            system, where = files(spark, new)
            system.rename(where, spark._jvm.org.apache.hadoop.fs.Path(old))


def prune_counters(counters: DataFrame, as_of: AsOf, days: int = COUNTER_DAYS) -> DataFrame:
    """Rate-limit counters young enough to matter."""
    return counters.filter(F.col("window_start") >= timestamp(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def _with_lists(df: DataFrame, names: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({n: F.coalesce(n, F.array().cast(types[n])) for n in names})
