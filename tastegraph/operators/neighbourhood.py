"""What surrounds a node: neighbours, rings, similar titles, entry points.

``refs`` has columns node_type and node_id; each function answers all of them in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.operators.views import top_rows
from tastegraph.plans.lineage import written

_REF = ["ref_type", "ref_id"]
# Fixed value: nodes asked about whose edges meet in one task.
REFS_IN_PART = 500


def _refs(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("node_type").alias("ref_type"), F.col("node_id").alias("ref_id"),
                       F.col("node_type").alias("subject_type"), F.col("node_id").alias("subject_id")).distinct()


def _edges_of(refs: DataFrame, eb: DataFrame) -> DataFrame:
    return eb.join(_refs(refs), ["subject_type", "subject_id"])


def _parts(refs: DataFrame) -> int:
    """How many parts the edges of the nodes asked about are dealt to: a task's memory follows the part, not the input."""
    return refs.count() // REFS_IN_PART + 1


def _degree(degree: DataFrame) -> DataFrame:
    return degree.select("node_type", F.col("node_id").alias("id"), "degree")


def hydrate(refs: DataFrame, node: DataFrame, degree: DataFrame) -> DataFrame:
    """Nodes by (node_type, node_id) or (node_type, slug), with their degree, 0 when unconnected."""
    wanted = refs.withColumnRenamed("node_id", "id")
    keys = ["node_type", "id"] if "id" in wanted.columns else ["node_type", "slug"]
    found = node.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return found.join(_degree(degree), ["node_type", "id"], "left").fillna(0, ["degree"])


def neighbors(refs: DataFrame, eb: DataFrame, node: DataFrame, degree: DataFrame, per_group: int = 8,
              groups: int | None = None) -> DataFrame:
    """The best neighbours of each node per predicate, and how many more there are.

    A person with several credits on one title is one neighbour. The remainder is counted by a
    partial aggregate and joined back rather than by a window over the whole group.
    """
    group, parts = [*_REF, "predicate"], _parts(refs)
    held = _edges_of(refs, eb).select(*group, "object_type", "object_id", "path_weight", "predicate_label")
    unique = held.repartition(parts, "ref_id").groupBy(*group, "object_type", "object_id").agg(
        F.min(F.struct("path_weight", "predicate_label")).alias("e")).repartition(parts, "object_type", "object_id")
    nodes = node.select(F.col("node_type").alias("object_type"), F.col("id").alias("object_id"), "slug", "label",
                        "sublabel", "image_path", "popularity").repartition(parts, "object_type", "object_id")
    found = unique.join(nodes, ["object_type", "object_id"]).select(
        *group, "object_type", "object_id", "e.path_weight", "e.predicate_label", "slug", "label", "sublabel",
        "image_path", "popularity")
    totals = found.groupBy(*group).agg(F.count("*").alias("total"), F.min("path_weight").alias("w"))
    order = [F.col("path_weight"), F.col("popularity").desc_nulls_last(), F.col("label"), F.col("object_id")]
    best = top_rows(found, group, order, per_group)
    if groups is not None:
        totals = top_rows(totals, _REF, [F.col("w"), F.col("predicate")], groups, "g").drop("g")
    d = degree.select(F.col("node_type").alias("object_type"), F.col("node_id").alias("object_id"), "degree")
    return (
        best.join(totals.drop("w"), group).join(d, ["object_type", "object_id"], "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("more", F.greatest(F.lit(0), F.col("total") - per_group)).drop("total")
    )


def ring1(refs: DataFrame, eb: DataFrame, first: int = 24) -> DataFrame:
    """The nearest distinct neighbours of each node: lowest weight, then (type, id)."""
    held = _edges_of(refs, eb).select(*_REF, "object_type", "object_id", "path_weight").repartition(_parts(refs), "ref_id")
    near = held.groupBy(*_REF, "object_type", "object_id").agg(F.min("path_weight").alias("path_weight"))
    order = [F.col("path_weight"), F.col("object_type"), F.col("object_id")]
    return top_rows(near, _REF, order, first).select(
        *_REF, F.col("object_type").alias("node_type"), F.col("object_id").alias("id"), "path_weight")


def ring2(refs: DataFrame, ring1: DataFrame, eb: DataFrame, degree: DataFrame, second: int = 60, hub: int = 400) -> DataFrame:
    """Neighbours of the first ring below the hub degree, the first ones by (type, id)."""
    quiet = degree.filter(F.col("degree") < hub).select(
        F.col("node_type").alias("object_type"), F.col("node_id").alias("object_id"))
    r = ring1.select(*_REF, F.col("node_type").alias("subject_type"), F.col("id").alias("subject_id"))
    # nodes reached twice are told apart beside their centre, not before the join
    reached = (
        eb.select("subject_type", "subject_id", "object_type", "object_id")
        .join(r, ["subject_type", "subject_id"]).select(*_REF, "object_type", "object_id")
        .join(quiet, ["object_type", "object_id"], "left_semi")
        .repartition(_parts(refs), "ref_id").distinct()
    )
    return top_rows(reached, _REF, [F.col("object_type"), F.col("object_id")], second).select(
        *_REF, F.col("object_type").alias("node_type"), F.col("object_id").alias("id"))


def rings(refs: DataFrame, ring1: DataFrame, ring2: DataFrame) -> DataFrame:
    """Both rings with each node's smallest hop; the centre itself is left out."""
    cols = [*_REF, "node_type", "id"]
    both = ring1.select(*cols, F.lit(1).alias("hop")).unionByName(ring2.select(*cols, F.lit(2).alias("hop")))
    centre = (F.col("node_type") == F.col("ref_type")) & (F.col("id") == F.col("ref_id"))
    return both.filter(~centre).groupBy(*cols).agg(F.min("hop").alias("hop"))


def _edges_at(edge: DataFrame, end: str) -> DataFrame:
    """How many edges have each node at this end."""
    return edge.groupBy(F.col(f"{end}_type").alias("node_type"), F.col(f"{end}_id").alias("id")).agg(F.count("*").alias("n"))


def forward_edges(eb: DataFrame) -> DataFrame:
    """Distinct edges between two nodes, in their declared direction."""
    loop = (F.col("subject_type") == F.col("object_type")) & (F.col("subject_id") == F.col("object_id"))
    return eb.filter(~F.col("is_inverse") & ~loop).select(
        "subject_type", "subject_id", "object_type", "object_id", F.col("canonical_predicate").alias("predicate"),
        F.col("path_weight").alias("weight")).distinct()


def by_quiet_end(edge: DataFrame) -> DataFrame:
    """Edges with ``q``, their end with fewer edges, and ``o``, the other one: a ring that holds a crowded node need not meet all its edges."""
    held = _edges_at(edge, "subject").unionByName(_edges_at(edge, "object")).groupBy("node_type", "id").agg(F.sum("n").alias("n"))
    sized = edge
    for end in ("subject", "object"):
        sized = sized.join(held.select(F.col("node_type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id"), F.col("n").alias(f"{end}_n")),
                           [f"{end}_type", f"{end}_id"])
    at_subject = F.col("subject_n") <= F.col("object_n")
    subject, target = (F.struct(F.col(f"{end}_type").alias("t"), F.col(f"{end}_id").alias("i")) for end in ("subject", "object"))
    return sized.select(F.when(at_subject, subject).otherwise(target).alias("q"), F.when(at_subject, target).otherwise(subject).alias("o"), *edge.columns)


def induced_edges(rings: DataFrame, eb: DataFrame) -> DataFrame:
    """Edges among each centre and its rings, one per unordered pair and predicate.

    Rings and edges are looked at several times, so they are stored.
    """
    rings = written(rings)
    members = rings.select(*_REF, "node_type", "id").unionByName(
        rings.select(*_REF, F.col("ref_type").alias("node_type"), F.col("ref_id").alias("id")).distinct())
    turned = by_quiet_end(written(forward_edges(eb)))
    near = members.select(*_REF, F.struct(F.col("node_type").alias("t"), F.col("id").alias("i")).alias("q"))
    beyond = near.withColumnRenamed("q", "o")
    inside = turned.join(near, "q").join(beyond, [*_REF, "o"], "left_semi")
    ends = inside.withColumn("a", F.struct(F.col("subject_type").alias("t"), F.col("subject_id").alias("i"))).withColumn(
        "b", F.struct(F.col("object_type").alias("t"), F.col("object_id").alias("i")))
    return (
        ends.groupBy(*_REF, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "predicate")
        .agg(F.min("weight").alias("weight"))
        .select(*_REF, F.col("x.t").alias("source_type"), F.col("x.i").alias("source_id"),
                F.col("y.t").alias("target_type"), F.col("y.i").alias("target_id"), "predicate", "weight")
    )


def similar_titles(refs: DataFrame, eb: DataFrame, title: DataFrame, k: int = 12) -> DataFrame:
    """The most similar titles of each title, from either side of the stored edge, with the reason."""
    similar = _edges_of(refs, eb.filter(F.col("predicate") == "similar_to")).select(
        F.col("ref_id").alias("title_id"), F.col("object_id").alias("id"), "attributes.reason", "attributes.score")
    best = top_rows(similar, ["title_id"], [F.col("score").desc(), F.col("id")], k)
    shown = title.select("id", "slug", "title", F.year("release_date").alias("release_year"), "poster_path")
    return best.join(shown, "id")


def featured_nodes(openers: DataFrame, node: DataFrame, degree: DataFrame, limit: int = 8) -> DataFrame:
    """Entry points: the curated (node_type, slug, position) list first, then well-connected nodes."""
    d = node.join(_degree(degree), ["node_type", "id"], "left")
    curated = (
        d.join(openers.select("node_type", "slug", "position"), ["node_type", "slug"])
        .select("node_type", "id", "slug", "label", F.coalesce("degree", F.lit(0)).alias("degree"),
                F.lit(0).alias("source"), F.col("position").cast("long").alias("place"))
    )
    filler = (
        d.filter(F.col("image_path").isNotNull() & (F.col("node_type") != "organization")
                 & F.col("degree").between(40, 400))
        .orderBy(F.desc("degree"), "node_type", "id").limit(limit)
        .select("node_type", "id", "slug", "label", "degree", F.lit(1).alias("source"), (-F.col("degree")).alias("place"))
    )
    once = curated.orderBy("place").limit(limit).unionByName(filler).groupBy("node_type", "id", "slug", "label", "degree").agg(
        F.min(F.struct("source", "place")).alias("o"))
    return once.orderBy("o", "node_type", "id").limit(limit).select(
        "node_type", "id", "slug", "label", "degree", F.col("o.source").alias("source"))


def best_connected(sets: DataFrame, degree: DataFrame) -> DataFrame:
    """The title with the highest degree of each (account_id, title_id) set."""
    d = degree.filter(F.col("node_type") == "title").select(F.col("node_id").alias("title_id"), "degree")
    return sets.join(d, "title_id").groupBy("account_id").agg(
        F.max_by("title_id", F.struct(F.col("degree"), -F.col("title_id"))).alias("title_id"))


def tracked_among(sets: DataFrame, title_state: DataFrame) -> DataFrame:
    """The part of each (account_id, title_id) set the account already tracks."""
    return sets.join(title_state.select("account_id", "title_id"), ["account_id", "title_id"], "left_semi")

