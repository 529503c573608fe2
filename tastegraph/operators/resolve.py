"""Entity resolution: which incoming records are entities already held.

``incoming`` titles have incoming_id, source, source_id, imdb_id, kind, title, release_year,
runtime_minutes; their cast is a separate table (incoming_id, position, source_id). Nothing is merged
on a name alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegraph.functions.text import normalize_title, reversed_name_key
from tastegraph.operators.views import top_rows
from tastegraph.plans.grams import similar_texts
from tastegraph.plans.lineage import written
from tastegraph.tables import Tables

# Resolution thresholds.
AUTO_SIMILARITY = 0.92
REVIEW_SIMILARITY = 0.8
CANDIDATES = 5
RUNTIME_TOLERANCE = 0.1
CAST_COMPARED = 5
FILMOGRAPHY_OVERLAP = 2
REASON_EXACT = "identical normalized title but no shared cast"
REASON_SIMILAR = "similar title, insufficient corroboration"
REASON_BIRTHDAY = "identical name and birthday, but no shared filmography"
REASON_ONE_TITLE = "identical name, exactly one shared title"


def primary_source(kind: Column) -> Column:
    """Id namespace of a title's kind; movie and show numbers overlap."""
    return F.when(kind == "show", "tmdb_tv").otherwise("tmdb")


def _ids(external_id: DataFrame, entity_type: str) -> DataFrame:
    return external_id.filter(F.col("entity_type") == entity_type).select("source", "source_id", "entity_id")


def match_primary(incoming: DataFrame, external_id: DataFrame, entity_type: str = "title") -> DataFrame:
    """Incoming records whose own (source, source_id) is already linked."""
    return incoming.join(_ids(external_id, entity_type), ["source", "source_id"]).select(
        "incoming_id", "entity_id", F.lit("external_id").alias("method"))


def match_secondary(incoming: DataFrame, external_id: DataFrame, title: DataFrame) -> DataFrame:
    """Incoming titles linked by their IMDb id to a title of the same kind."""
    imdb = _ids(external_id, "title").filter(F.col("source") == "imdb").select(
        F.col("source_id").alias("imdb_id"), "entity_id")
    kinds = title.select(F.col("id").alias("entity_id"), F.col("kind").alias("held_kind"))
    return (
        incoming.join(imdb, "imdb_id").join(kinds, "entity_id").filter(F.col("kind") == F.col("held_kind"))
        .select("incoming_id", "entity_id", F.lit("crosswalk").alias("method"))
    )


def kind_collisions(incoming: DataFrame, external_id: DataFrame, title: DataFrame) -> DataFrame:
    """Primary id hits on a title of the other kind: errors, never matches."""
    kinds = title.select(F.col("id").alias("entity_id"), F.col("kind").alias("held_kind"))
    hits = incoming.join(_ids(external_id, "title"), ["source", "source_id"]).join(kinds, "entity_id")
    return hits.filter(F.col("kind") != F.col("held_kind")).select(
        "incoming_id", "source", "source_id", "entity_id", "kind", "held_kind")


def block_candidates(incoming: DataFrame, title: DataFrame, min_sim: float = REVIEW_SIMILARITY,
                     k: int = CANDIDATES) -> DataFrame:
    """Up to k held titles per incoming title: same kind, year within one, similar normalised title.

    Incoming and held titles with the same key, kind and year are compared once. Of held copies only
    the k first ids can be among the k best, because similarity is equal and ids break ties.
    """
    inc = incoming.withColumn("l_text", normalize_title(F.col("title"))).withColumnRenamed("release_year", "l_year")
    held = title.select("id", "kind", "runtime_minutes", F.col("sort_title").alias("r_text"), F.col("release_year").alias("r_year"))
    copies = top_rows(held, ["r_text", "kind", "r_year"], [F.col("id")], k, "copy")
    year_ok = F.coalesce(F.abs(F.col("l_year") - F.col("r_year")) <= 1, F.lit(True))
    pairs = similar_texts(inc.select("kind", "l_text", "l_year").distinct(),
                          held.select("kind", "r_text", "r_year").distinct(), min_sim, ["kind"], year_ok)
    p, h = pairs.alias("p"), copies.alias("h")
    same = (F.col("p.kind") == F.col("h.kind")) & (F.col("p.r_text") == F.col("h.r_text")) & F.col("p.r_year").eqNullSafe(F.col("h.r_year"))
    met = p.join(h, same).select("p.kind", "p.l_text", "p.l_year", "p.r_text", "p.r_year", "p.sim", "h.id", "h.runtime_minutes")
    best = top_rows(met, ["kind", "l_text", "l_year"], [F.col("sim").desc(), F.col("id")], k, "rank").alias("b")
    i = inc.alias("i")
    asked = (F.col("i.kind") == F.col("b.kind")) & (F.col("i.l_text") == F.col("b.l_text")) & F.col("i.l_year").eqNullSafe(F.col("b.l_year"))
    return i.join(best, asked).select(
        "i.incoming_id", F.col("b.id").alias("candidate_id"), "b.rank", "b.sim", (F.col("b.r_text") == F.col("i.l_text")).alias("exact"),
        F.col("b.r_text").alias("candidate_title"), F.col("b.r_year").alias("candidate_year"),
        F.col("i.runtime_minutes").alias("l_runtime"), F.col("b.runtime_minutes").alias("candidate_runtime"))


def runtime_ok(incoming: Column, held: Column, tol: float = RUNTIME_TOLERANCE) -> Column:
    """Runtimes agree within a tenth of the held one; an unknown runtime contradicts nothing."""
    return F.coalesce(F.abs(held - incoming) / F.greatest(held, F.lit(1)) <= tol, F.lit(True))


def shared_cast(cast: DataFrame, candidates: DataFrame, credit: DataFrame, external_id: DataFrame,
                source: str = "tmdb") -> DataFrame:
    """How many of an incoming title's top five cast act in each of its candidates."""
    people = _ids(external_id, "person").filter(F.col("source") == source).select(
        "source_id", F.col("entity_id").alias("person_id"))
    top = cast.filter(F.col("position") <= CAST_COMPARED).select("incoming_id", F.col("source_id").cast("string"))
    known = top.join(people, "source_id")
    acts = credit.filter(F.col("predicate") == "acted_in").select(F.col("title_id").alias("candidate_id"), "person_id")
    met = candidates.select("incoming_id", "candidate_id").join(known, "incoming_id").join(
        acts, ["candidate_id", "person_id"], "left_semi")
    return met.groupBy("incoming_id", "candidate_id").agg(F.countDistinct("source_id").alias("shared_cast"))


def judge_candidates(incoming: DataFrame, cast: DataFrame, t: Tables, person_source: str = "tmdb") -> DataFrame:
    """Candidates of titles no id resolves, each with its evidence and whether it would be accepted."""
    known = match_primary(incoming, t.external_id).select("incoming_id").unionByName(
        match_secondary(incoming, t.external_id, t.title).select("incoming_id")).distinct()
    rest = incoming.join(known, "incoming_id", "left_anti")
    # looked for once, though met twice: by their cast and as they are
    candidates = written(block_candidates(rest, t.title))
    shared = shared_cast(cast, candidates, t.credit, t.external_id, person_source)
    c = candidates.join(shared, ["incoming_id", "candidate_id"], "left").withColumns({
        "shared_cast": F.coalesce("shared_cast", F.lit(0)),
        "runtime_compatible": runtime_ok(F.col("l_runtime"), F.col("candidate_runtime")),
    })
    corroborated = F.col("runtime_compatible") & (F.col("shared_cast") >= 1)
    return c.withColumn("method", F.when(corroborated & F.col("exact"), "blocking_exact").when(
        corroborated & (F.col("sim") >= AUTO_SIMILARITY), "fuzzy_corroborated"))


def resolve_titles(incoming: DataFrame, cast: DataFrame, t: Tables, person_source: str = "tmdb") -> DataFrame:
    """One decision per incoming title: external id, crosswalk, first acceptable candidate, or created."""
    primary = match_primary(incoming, t.external_id)
    secondary = match_secondary(incoming, t.external_id, t.title).groupBy("incoming_id", "method").agg(
        F.min("entity_id").alias("entity_id"))
    judged = judge_candidates(incoming, cast, t, person_source).filter(F.col("method").isNotNull()).groupBy("incoming_id").agg(
        F.min_by(F.struct(F.col("candidate_id").alias("entity_id"), F.col("method")), "rank").alias("d"))
    out = incoming.select("incoming_id")
    for name, frame in (("p", primary), ("s", secondary), ("d", judged.select("incoming_id", "d.*"))):
        out = out.join(frame.select("incoming_id", F.struct("entity_id", "method").alias(name)), "incoming_id", "left")
    best = F.coalesce("p", "s", "d")
    return out.select("incoming_id", best["entity_id"].alias("entity_id"),
                      F.coalesce(best["method"], F.lit("created")).alias("method"))


def review_queue(incoming: DataFrame, cast: DataFrame, t: Tables, person_source: str = "tmdb") -> DataFrame:
    """Candidates looked at and not accepted, up to the accepted one, with what spoke for and against."""
    judged = judge_candidates(incoming, cast, t, person_source)
    # an incoming title has few candidates, so its window is small
    accepted = F.min(F.when(F.col("method").isNotNull(), F.col("rank"))).over(Window.partitionBy("incoming_id"))
    open_ = judged.withColumn("accepted", accepted).filter(F.col("accepted").isNull() | (F.col("rank") < F.col("accepted")))
    evidence = F.to_json(F.struct("candidate_title", "candidate_year", "candidate_runtime", "shared_cast", "runtime_compatible"))
    return open_.select("incoming_id", "candidate_id", "rank", "sim", "shared_cast", "runtime_compatible",
                        F.when(F.col("exact"), REASON_EXACT).otherwise(REASON_SIMILAR).alias("reason"),
                        evidence.alias("evidence"))


def person_candidates(incoming: DataFrame, person: DataFrame, external_id: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """People an incoming person may be: by id, by IMDb id, else up to k with the same name.

    ``incoming`` has incoming_id, source, source_id, imdb_id, name, birthday.
    """
    primary = match_primary(incoming, external_id, "person")
    imdb = _ids(external_id, "person").filter(F.col("source") == "imdb").select(F.col("source_id").alias("imdb_id"), "entity_id")
    rest = incoming.join(primary, "incoming_id", "left_anti")
    secondary = rest.join(imdb, "imdb_id").select("incoming_id", "entity_id", F.lit("crosswalk").alias("method"))
    named = rest.join(secondary, "incoming_id", "left_anti")
    # both name keys in one equi join; people of one name are cut to the k first ids before it
    held = person.select("id", F.explode(F.array(
        F.struct(F.lit("sort").alias("how"), F.col("sort_name").alias("key")),
        F.struct(F.lit("name").alias("how"), F.lower("name").alias("key")))).alias("n")).select("id", "n.*")
    first = top_rows(held, ["how", "key"], [F.col("id")], k, "copy")
    asked = named.select("incoming_id", F.explode(F.array(
        F.struct(F.lit("sort").alias("how"), reversed_name_key(F.col("name")).alias("key")),
        F.struct(F.lit("name").alias("how"), F.lower("name").alias("key")))).alias("n")).select("incoming_id", "n.*")
    same = asked.join(first, ["how", "key"]).select("incoming_id", F.col("id").alias("entity_id")).distinct()
    by_name = top_rows(same, ["incoming_id"], [F.col("entity_id")], k, "rank").select(
        "incoming_id", "entity_id", F.lit("name").alias("method"), "rank")
    certain = primary.unionByName(secondary).withColumn("rank", F.lit(1))
    return certain.unionByName(by_name)


def judge_people(incoming: DataFrame, known_titles: DataFrame, t: Tables) -> DataFrame:
    """Person candidates with birthday agreement, shared titles and the verdict on each.

    ``known_titles`` has (incoming_id, title_id).
    """
    cand = person_candidates(incoming, t.person, t.external_id)
    held = t.person.select(F.col("id").alias("entity_id"), F.col("birthday").alias("held_birthday"))
    c = cand.join(held, "entity_id", "left").join(incoming.select("incoming_id", "birthday"), "incoming_id")
    worked = t.credit.select(F.col("person_id").alias("entity_id"), "title_id").distinct()
    overlap = (
        c.filter(F.col("method") == "name").select("incoming_id", "entity_id")
        .join(known_titles.distinct(), "incoming_id").join(worked, ["entity_id", "title_id"], "left_semi")
        .groupBy("incoming_id", "entity_id").agg(F.count("*").alias("overlap"))
    )
    same_day = F.coalesce(F.col("birthday") == F.col("held_birthday"), F.lit(False))
    conflict = F.coalesce(F.col("birthday") != F.col("held_birthday"), F.lit(False))
    certain = F.col("method") != "name"
    return c.join(overlap, ["incoming_id", "entity_id"], "left").withColumn(
        "overlap", F.coalesce("overlap", F.lit(0))).withColumn(
        "verdict",
        F.when(certain, "match").when(conflict, "different").when(F.col("overlap") >= FILMOGRAPHY_OVERLAP, "match")
        .when((F.col("overlap") == 1) | same_day, "review").otherwise("different")).withColumn(
        "reason", F.when(F.col("verdict") == "review", F.when(same_day, REASON_BIRTHDAY).otherwise(REASON_ONE_TITLE)))


def resolve_people(incoming: DataFrame, known_titles: DataFrame, t: Tables) -> DataFrame:
    """One decision per incoming person: by id, by shared filmography, or a new person."""
    matched = judge_people(incoming, known_titles, t).filter(F.col("verdict") == "match").groupBy("incoming_id").agg(
        F.min_by(F.struct("entity_id", "method"), F.struct("rank", "entity_id")).alias("m"))
    method = F.when(F.col("m.method") == "name", "fuzzy_corroborated").otherwise(F.col("m.method"))
    return incoming.select("incoming_id").join(matched, "incoming_id", "left").select(
        "incoming_id", F.col("m.entity_id").alias("entity_id"), F.coalesce(method, F.lit("created")).alias("method"))


def people_review(incoming: DataFrame, known_titles: DataFrame, t: Tables) -> DataFrame:
    """Same-named people in the middle band, looked at before any match was found."""
    judged = judge_people(incoming, known_titles, t)
    matched = judged.filter(F.col("verdict") == "match").groupBy("incoming_id").agg(F.min("rank").alias("accepted"))
    return judged.join(matched, "incoming_id", "left").filter(
        (F.col("verdict") == "review") & (F.col("accepted").isNull() | (F.col("rank") < F.col("accepted")))
    ).select("incoming_id", "entity_id", "overlap", "reason")

