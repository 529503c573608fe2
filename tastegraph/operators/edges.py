"""The logical graph: one edge surface, both directions, degrees, nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.plans.store import current, upsert
from tastegraph.sources.ontology import with_meta
from tastegraph.tables import Tables

# attributes an edge can carry, by name and type
ATTRIBUTES = {
    "billing_order": "int", "character_id": None,  # the type of the model's ids
    "character": "string", "job": "string",
    "salience": "double", "score": "double", "reason": "string", "method": "string",
}


def edge(credit: DataFrame, edge: DataFrame, edge_derived: DataFrame) -> DataFrame:
    """Credits, generic edges and derived edges as one table; a credit points at its episode if set."""
    id_type = dict(credit.dtypes).get("character_id", "string")

    def attrs(**present: Column) -> Column:
        fields = []
        for name, kind in ATTRIBUTES.items():
            fields.append(present.get(name, F.lit(None)).cast(kind or id_type).alias(name))
        return F.struct(*fields).alias("attributes")

    credits = credit.select(
        "id", F.lit("person").alias("subject_type"), F.col("person_id").alias("subject_id"), "predicate",
        F.when(F.col("episode_id").isNotNull(), "episode").otherwise("title").alias("object_type"),
        F.coalesce("episode_id", "title_id").alias("object_id"),
        attrs(billing_order=F.col("billing_order"), character_id=F.col("character_id"),
              character=F.col("character_name_raw"), job=F.col("job")),
        F.lit("asserted").alias("provenance"), "confidence",
    )
    ends = ["id", "subject_type", "subject_id", "predicate", "object_type", "object_id"]
    asserted = edge.select(*ends, attrs(salience=F.col("salience")), "provenance", "confidence")
    derived = edge_derived.select(
        *ends,
        attrs(score=F.col("score"), reason=F.col("reason"), method=F.col("method")),
        F.lit("derived").alias("provenance"), "confidence",
    )
    return credits.unionByName(asserted).unionByName(derived)


def edge_bidirectional(edge: DataFrame, meta: DataFrame) -> DataFrame:
    """Every edge forward and inverse with its predicate's weight and label; structural ones dropped.

    The edges are read once and doubled with ``explode``. Symmetric edges are stored once, so they are
    turned around too. Metadata is joined on the declared name, never the inverse's.
    """
    declared = meta.filter(~F.col("is_structural")).select(
        "predicate", "inverse", "label", "inverse_label", "path_weight", "excluded_from_path_intermediates"
    )
    sides = F.array(
        F.struct(
            F.col("subject_type"), F.col("subject_id"), F.col("predicate"), F.col("object_type"), F.col("object_id"),
            F.lit(False).alias("is_inverse"), F.col("label").alias("predicate_label"),
        ),
        F.struct(
            F.col("object_type").alias("subject_type"), F.col("object_id").alias("subject_id"),
            F.col("inverse").alias("predicate"), F.col("subject_type").alias("object_type"),
            F.col("subject_id").alias("object_id"), F.lit(True).alias("is_inverse"),
            F.col("inverse_label").alias("predicate_label"),
        ),
    )
    return with_meta(edge, declared).select(
        F.explode(sides).alias("s"), F.col("predicate").alias("canonical_predicate"), "attributes", "provenance",
        "confidence", "path_weight", "excluded_from_path_intermediates",
    ).select(
        "s.subject_type", "s.subject_id", "s.predicate", "s.object_type", "s.object_id", "attributes", "provenance",
        "confidence", "s.is_inverse", "canonical_predicate", "path_weight", "s.predicate_label",
        "excluded_from_path_intermediates",
    )


def _ends(edge: DataFrame) -> DataFrame:
    """The nodes at both ends of every edge, as (node_type, node_id)."""
    ends = F.array(
        F.struct(F.col("subject_type").alias("node_type"), F.col("subject_id").alias("node_id")),
        F.struct(F.col("object_type").alias("node_type"), F.col("object_id").alias("node_id")),
    )
    return edge.select(F.explode(ends).alias("e")).select("e.node_type", "e.node_id")


def node_degree(edge: DataFrame) -> DataFrame:
    """Edge rows touching each node, counted over both ends with map-side partial counts."""
    return _ends(edge).groupBy("node_type", "node_id").agg(F.count("*").alias("degree"))


def degree_changes(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(node_type, node_id, change): what added and removed edges do to degrees; nodes whose degree stays are left out."""
    signed = _ends(added).withColumn("change", F.lit(1)).unionByName(_ends(removed).withColumn("change", F.lit(-1)))
    return signed.groupBy("node_type", "node_id").agg(F.sum("change").alias("change")).filter(F.col("change") != 0)


def update_degree(degree: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Degrees after edges came and went, without counting the others again; a node without edges has no row."""
    both = degree.select("node_type", "node_id", "degree").unionByName(degree_changes(added, removed).withColumnRenamed("change", "degree"))
    return both.groupBy("node_type", "node_id").agg(F.sum("degree").alias("degree")).filter(F.col("degree") > 0)


def keep_degree(path: str, added: DataFrame, removed: DataFrame, change_no: int, buckets: int = 64) -> None:
    """Bring a kept degree table at ``path`` up to date by change number ``change_no``, from 0; only buckets of touched nodes are written.

    A change that is made again under its number finds the table as it was before it and writes the same once more.
    """

    def merge(held: DataFrame | None, changes: DataFrame) -> DataFrame:
        new = changes.withColumnRenamed("change", "degree")
        both = new if held is None else held.select("node_type", "node_id", "degree").unionByName(new)
        return both.groupBy("node_type", "node_id").agg(F.sum("degree").alias("degree"))

    upsert(degree_changes(added, removed), path, ["node_type", "node_id"], change_no, merge, buckets)


def kept_degree(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept degrees; None if no change was made yet."""
    held = current(spark, path)
    return None if held is None else held.filter(F.col("degree") > 0)


def node(t: Tables) -> DataFrame:
    """All entities as (node_type, id, slug, label, sublabel, image_path, popularity)."""

    def part(df: DataFrame, kind: str, label: str, sublabel: Column, image: Column, popularity: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("node_type"), "id", "slug", F.col(label).alias("label"),
            sublabel.cast("string").alias("sublabel"), image.cast("string").alias("image_path"),
            popularity.cast("double").alias("popularity"),
        )

    null = F.lit(None)
    image = lambda df, name: F.col(name) if name in df.columns else null
    frames = [
        part(t.title, "title", "title", F.year("release_date"), F.col("poster_path"), F.col("popularity")),
        part(t.person, "person", "name", F.col("known_for_department"), F.col("profile_path"), F.col("popularity")),
        part(t.concept, "concept", "label", F.col("scheme"), null, null),
        part(t.collection, "collection", "name", F.col("kind"), image(t.collection, "poster_path"), null),
        part(t.organization, "organization", "name", F.col("kind"), image(t.organization, "logo_path"), null),
        part(t.character, "character", "name", null, null, null),
        part(t.work, "work", "title", F.col("kind"), null, null),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def graph(t: Tables) -> Tables:
    """The bundle with the logical edge table, both directions, degrees and nodes added.

    Jobs that run several graph queries should write these once and read them back.
    """
    logical = edge(t.credit, t.edge, t.edge_derived)
    return t.replace(
        logical_edge=logical,
        edge_both=edge_bidirectional(logical, t.predicate_meta),
        degree=node_degree(logical),
        node=node(t),
    )
