"""Integrity checks as jobs: each returns violations (rule, table, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.operators.edges import node as node_table
from tastegraph.sources.ontology import ENTITY_TYPES, with_meta
from tastegraph.tables import Tables

# Tracking vocabularies.
STATUSES = ("watchlist", "watching", "watched", "abandoned")
EVENT_KINDS = ("status_change", "favorited", "unfavorited")
DATE_PRECISIONS = ("exact", "day", "month", "year", "unknown")
OFFER_TYPES = ("flatrate", "free", "ads", "rent", "buy")


def violations(df: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_declared(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Edges whose predicate is not declared."""
    unknown = edges.join(meta.select("predicate"), "predicate", "left_anti")
    return violations(unknown, "declared", "edge", F.col("id"), F.col("predicate"))


def check_storage(edges: DataFrame, meta: DataFrame, table: str) -> DataFrame:
    """Edges kept in a table other than the one their predicate declares."""
    wrong = with_meta(edges, meta.select("predicate", "storage")).filter(F.col("storage") != table)
    return violations(wrong, "storage", table, F.col("id"), F.concat_ws(" belongs in ", "predicate", "storage"))


def check_domain_range(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Edges whose subject or object type the predicate does not allow."""
    e = with_meta(edges, meta.select("predicate", "domain", "range"))
    bad_domain = e.filter(~F.expr("array_contains(domain, subject_type)"))
    bad_range = e.filter(~F.expr("array_contains(range, object_type)"))
    return _union([
        violations(bad_domain, "domain", "edge", F.col("id"), F.concat_ws(" from ", "predicate", "subject_type")),
        violations(bad_range, "range", "edge", F.col("id"), F.concat_ws(" to ", "predicate", "object_type")),
    ])


def check_subtypes(edges: DataFrame, meta: DataFrame, concept: DataFrame, organization: DataFrame) -> DataFrame:
    """Edges to a concept scheme or organization kind the predicate does not allow."""
    limited = meta.filter(F.size("range_subtypes") > 0).select("predicate", "range_subtypes")
    e = with_meta(edges, limited)
    found = concept.select(F.lit("concept").alias("object_type"), F.col("id").alias("object_id"),
                           F.col("scheme").alias("subtype")).unionByName(
        organization.select(F.lit("organization").alias("object_type"), F.col("id").alias("object_id"),
                            F.col("kind").alias("subtype")))
    wrong = e.join(found, ["object_type", "object_id"], "left").filter(
        F.col("subtype").isNull() | ~F.expr("array_contains(range_subtypes, subtype)"))
    return violations(wrong, "subtype", "edge", F.col("id"),
                      F.concat_ws(" to ", F.col("predicate"), F.coalesce("subtype", F.lit("nothing"))))


def check_orphans(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Edge ends that refer to no entity; parts (seasons, episodes) are not nodes and are left out."""
    nodes = node.select("node_type", F.col("id").alias("node_id"))
    types = [name for name, e in ENTITY_TYPES.items() if e["graph_node"]]
    ends = edges.select("id", "predicate", F.explode(F.array(
        F.struct(F.lit("subject").alias("side"), F.col("subject_type").alias("node_type"), F.col("subject_id").alias("node_id")),
        F.struct(F.lit("object").alias("side"), F.col("object_type").alias("node_type"), F.col("object_id").alias("node_id")),
    )).alias("e")).select("id", "e.*").filter(F.col("node_type").isin(types))
    lost = ends.join(nodes, ["node_type", "node_id"], "left_anti")
    return violations(lost, "orphan", "edge", F.col("id"), F.concat_ws(" ", "side", "node_type", "node_id"))


def check_vocab(t: Tables) -> DataFrame:
    """Values outside the closed vocabularies and rows whose columns contradict each other."""
    out = [
        violations(t.title_state.filter(~F.col("status").isin(*STATUSES)), "status", "title_state",
                   F.concat_ws("/", "account_id", "title_id"), F.col("status")),
        violations(t.rating.filter(~F.col("value").between(1, 10)), "rating_range", "rating", F.col("id"), F.col("value")),
        violations(t.viewing.filter(~F.col("date_precision").isin(*DATE_PRECISIONS)), "precision", "viewing",
                   F.col("id"), F.col("date_precision")),
        violations(t.viewing.filter((F.col("date_precision") == "unknown") != F.col("watched_on").isNull()),
                   "viewing_date", "viewing", F.col("id"), F.col("date_precision")),
        violations(t.availability.filter(~F.col("offer_type").isin(*OFFER_TYPES)), "offer_type", "availability",
                   F.concat_ws("/", "title_id", "organization_id"), F.col("offer_type")),
    ]
    if "state_event" in t:
        change = F.col("event_kind") == "status_change"
        shaped = F.when(change, F.col("to_status").isNotNull()).otherwise(
            F.col("from_status").isNull() & F.col("to_status").isNull())
        out.append(violations(t.state_event.filter(~F.col("event_kind").isin(*EVENT_KINDS)), "event_kind",
                              "state_event", F.col("id"), F.col("event_kind")))
        out.append(violations(t.state_event.filter(~shaped), "event_shape", "state_event", F.col("id"),
                              F.col("event_kind")))
    return _union(out)


def _duplicates(df: DataFrame, table: str, keys: list[Column]) -> DataFrame:
    key = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    again = df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return violations(again, "unique", table, F.col("k"), F.col("n"))


def check_keys(t: Tables) -> DataFrame:
    """Rows that share a natural key; NULL parts of a key compare as equal."""
    c = F.col
    return _union([
        _duplicates(t.credit, "credit", [c("person_id"), c("title_id"), c("predicate"), c("episode_id"), c("job")]),
        _duplicates(t.edge, "edge", [c("subject_type"), c("subject_id"), c("predicate"), c("object_type"), c("object_id")]),
        _duplicates(t.edge_derived, "edge_derived",
                    [c("subject_type"), c("subject_id"), c("predicate"), c("object_type"), c("object_id"), c("method")]),
        _duplicates(t.crosswalk, "crosswalk", [F.lower("keyword_label"), c("concept_id")]),
        _duplicates(t.external_id, "external_id", [c("source"), c("source_id"), c("entity_type")]),
    ])


def check_ontology(meta: DataFrame) -> DataFrame:
    """Contradictions inside the declaration itself."""
    known = F.array(*[F.lit(n) for n in ENTITY_TYPES])
    key, c = F.col("predicate"), F.col
    # a dozen rows against themselves: an inverse must not be another predicate's name
    names = meta.select(c("predicate").alias("other"))
    clash = meta.filter(~c("is_symmetric")).join(names, c("inverse") == c("other"), "left_semi")
    twice = meta.groupBy("inverse").agg(F.count("*").alias("n"), F.min("predicate").alias("predicate")).filter("n > 1")
    return _union([
        violations(meta.filter(F.size(F.array_except(F.concat("domain", "range"), known)) > 0), "known_type",
                   "predicate_meta", key, F.concat_ws(",", F.array_except(F.concat("domain", "range"), known))),
        violations(meta.filter(~c("is_structural") & F.coalesce(c("path_weight") <= 0, F.lit(True))), "weight",
                   "predicate_meta", key, c("path_weight")),
        violations(meta.filter(c("is_symmetric") != (c("inverse") == key)), "symmetric_inverse", "predicate_meta", key,
                   c("inverse")),
        violations(meta.filter(c("narration").isNull() | ~c("narration").contains("{subject}")
                               | ~c("narration").contains("{object}")), "narration", "predicate_meta", key, c("narration")),
        violations(clash, "inverse_is_predicate", "predicate_meta", key, c("inverse")),
        violations(twice, "inverse_unique", "predicate_meta", key, c("inverse")),
    ])


def check_all(t: Tables) -> DataFrame:
    """Every check over the bundle."""
    from tastegraph.operators.edges import edge

    logical = edge(t.credit, t.edge, t.edge_derived)
    return _union([
        check_declared(logical, t.predicate_meta),
        check_storage(t.credit, t.predicate_meta, "credit"), check_storage(t.edge, t.predicate_meta, "edge"),
        check_storage(t.edge_derived, t.predicate_meta, "edge_derived"),
        check_domain_range(logical, t.predicate_meta),
        check_subtypes(logical, t.predicate_meta, t.concept, t.organization),
        check_orphans(logical, node_table(t)), check_vocab(t), check_keys(t), check_ontology(t.predicate_meta),
    ])
