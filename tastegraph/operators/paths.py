"""Ranked, diverse and narrated paths between pairs of nodes, for many pairs at once.

``pairs`` has columns pair_id, a_type, a_id, b_type, b_id. Each pair keeps its own frontiers; hubs
above the ban are pruned before any join fans out from them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegraph.functions.scalars import edge_cost, narrate
from tastegraph.operators.views import top_rows
from tastegraph.plans.lineage import checkpoint

# Path ranking.
HUB_BAN = 2000
PATHS_RANKED = 60
PATHS_RETURNED = 3
MAX_OVERLAP = 0.5

_STEP = ["predicate", "label", "inverse"]
# how paths of a pair are ordered, and what costs may differ by and still be one to nine digits
_ORDER = ["round(cost, 9)", "len", "steps"]
_ROUNDING = 1e-8


class Frontiers(NamedTuple):
    """What paths between the pairs are made of, each written once: all steps, those leaving A and those entering B."""

    steps: DataFrame
    degree: DataFrame
    out: DataFrame
    into: DataFrame


def _priced(steps: DataFrame, degree: DataFrame) -> DataFrame:
    """Steps with the target's degree and the cost of stepping on it."""
    d = degree.select(F.col("node_type").alias("object_type"), F.col("node_id").alias("object_id"), "degree")
    return steps.join(d, ["object_type", "object_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn(
        "cost", edge_cost(F.col("path_weight"), F.col("degree"), F.col("confidence"))).drop("path_weight", "confidence")


def _step(alias: str, to_type: Column, to_id: Column) -> Column:
    return F.struct(*[F.col(f"{alias}.{c}").alias(c) for c in _STEP], to_type.alias("node_type"), to_id.alias("node_id"))


def frontiers(pairs: DataFrame, eb: DataFrame, degree: DataFrame) -> Frontiers:
    """Steps leaving A towards an allowed middle and steps entering B.

    The edges are read and written once in a narrow form; those at either end are picked first and only they are priced.
    """
    steps = checkpoint(eb.filter(~F.col("excluded_from_path_intermediates")).select(
        "subject_type", "subject_id", "object_type", "object_id", F.col("canonical_predicate").alias("predicate"),
        F.col("predicate_label").alias("label"), F.col("is_inverse").alias("inverse"), "path_weight", "confidence"))
    degree = checkpoint(degree.select("node_type", "node_id", "degree"))
    starts = pairs.select("pair_id", "a_type", "a_id", "b_type", "b_id",
                          F.col("a_type").alias("subject_type"), F.col("a_id").alias("subject_id"))
    ends = pairs.select("pair_id", F.col("b_type").alias("object_type"), F.col("b_id").alias("object_id"))
    at_b = (F.col("object_type") == F.col("b_type")) & (F.col("object_id") == F.col("b_id"))
    out = _priced(steps.join(starts, ["subject_type", "subject_id"]).filter(~at_b), degree).filter(F.col("degree") <= HUB_BAN)
    into = _priced(steps.join(ends, ["object_type", "object_id"]), degree)
    return Frontiers(steps, degree, checkpoint(out), checkpoint(into))


def paths2(f: Frontiers) -> DataFrame:
    """Two-hop paths A → m → B."""
    o, i = f.out.alias("o"), f.into.alias("i")
    meet = (
        (F.col("o.pair_id") == F.col("i.pair_id")) & (F.col("o.object_type") == F.col("i.subject_type"))
        & (F.col("o.object_id") == F.col("i.subject_id"))
    )
    return o.join(i, meet).select(
        F.col("o.pair_id").alias("pair_id"), F.lit(2).alias("len"),
        (F.col("o.cost") + F.col("i.cost")).alias("cost"),
        F.array(_step("o", F.col("o.object_type"), F.col("o.object_id")),
                _step("i", F.col("i.object_type"), F.col("i.object_id"))).alias("steps"),
        (F.col("o.degree")).alias("deg_sum"),
    )


def ways(f: Frontiers, bound: DataFrame | None = None) -> DataFrame:
    """Two-step ways from A to a node that reaches B, with what they cost and the cheapest step from there on.

    ``bound`` (pair_id, bound) is what a path may cost at most to matter; a pair without one is not bounded. A first step is dropped before it
    fans out if the cheapest middle step and the pair's cheapest last step already take it beyond the bound, and a way as soon as
    it lands where the last step must be too dear, or where none leads to this pair's B.
    """
    reached = f.out.select(F.col("object_type").alias("subject_type"), F.col("object_id").alias("subject_id")).distinct()
    goals = f.into.select(F.col("subject_type").alias("object_type"), F.col("subject_id").alias("object_id")).distinct()
    # the middle step must leave a node A reaches and land on a node that reaches B
    middle = checkpoint(_priced(
        f.steps.join(reached, ["subject_type", "subject_id"], "left_semi").join(goals, ["object_type", "object_id"], "left_semi"),
        f.degree).filter(F.col("degree") <= HUB_BAN))
    last = f.into.groupBy("pair_id", F.col("subject_type").alias("object_type"), F.col("subject_id").alias("object_id")).agg(F.min("cost").alias("rest"))
    limits = last.groupBy("pair_id").agg(F.min("rest").alias("nearest"))
    limits = limits.withColumn("bound", F.lit(None).cast("double")) if bound is None else limits.join(bound, "pair_id", "left")
    within = lambda cost: F.col("bound").isNull() | (cost <= F.col("bound") + _ROUNDING)
    least = middle.agg(F.min("cost")).scalar()
    o, m = f.out.join(limits, "pair_id").filter(within(F.col("cost") + least + F.col("nearest"))).alias("o"), middle.alias("m")

    def differs(kind: str, ident: str) -> Column:
        return ~((F.col("m.object_type") == F.col(kind)) & (F.col("m.object_id") == F.col(ident)))

    met = o.join(m, (F.col("m.subject_type") == F.col("o.object_type")) & (F.col("m.subject_id") == F.col("o.object_id"))).filter(
        differs("o.a_type", "o.a_id") & differs("o.b_type", "o.b_id") & differs("o.object_type", "o.object_id")).filter(
        within(F.col("o.cost") + F.col("m.cost") + F.col("nearest")))
    found = met.select(
        F.col("o.pair_id").alias("pair_id"), F.col("m.object_type").alias("object_type"), F.col("m.object_id").alias("object_id"), "bound",
        (F.col("o.cost") + F.col("m.cost")).alias("way"), (F.col("o.degree") + F.col("m.degree")).alias("deg_sum"),
        F.array(_step("o", F.col("o.object_type"), F.col("o.object_id")), _step("m", F.col("m.object_type"), F.col("m.object_id"))).alias("first"))
    return found.join(last, ["pair_id", "object_type", "object_id"]).filter(within(F.col("way") + F.col("rest"))).select(
        "pair_id", F.col("object_type").alias("subject_type"), F.col("object_id").alias("subject_id"), "way", "deg_sum", "first")


def paths3(f: Frontiers, k: int = PATHS_RANKED, bound: DataFrame | None = None) -> DataFrame:
    """Three-hop paths A → m1 → m2 → B without returning to an end or staying on a middle, those that can be among the k cheapest.

    Of the ways from A to one m2 only the k cheapest can be on the k cheapest paths, whichever step enters B, so the
    others go before the last join.
    """
    # costs are compared to nine digits after the last step is added: within rounding of the k-th nothing is cut
    place = Window.partitionBy("pair_id", "subject_type", "subject_id").orderBy("way")
    counted = ways(f, bound).withColumn("rn", F.row_number().over(place)).withColumn(
        "kth", F.max(F.when(F.col("rn") <= k, F.col("way"))).over(Window.partitionBy("pair_id", "subject_type", "subject_id")))
    i = f.into.alias("i")
    return counted.filter(F.col("way") <= F.col("kth") + _ROUNDING).join(i, ["pair_id", "subject_type", "subject_id"]).select(
        "pair_id", F.lit(3).alias("len"), (F.col("way") + F.col("i.cost")).alias("cost"),
        F.concat("first", F.array(_step("i", F.col("i.object_type"), F.col("i.object_id")))).alias("steps"), "deg_sum")


def cheapest(paths: DataFrame, k: int = PATHS_RANKED) -> DataFrame:
    """The k cheapest of each pair's paths with their rarity; ties fall to length, then to the steps."""
    rarity = 1.0 / (1 + F.log1p(F.col("deg_sum").cast("double")))
    ranked = top_rows(paths, ["pair_id"], [F.expr(o) for o in _ORDER], k, "rank")
    return ranked.withColumn("rarity", rarity).drop("deg_sum")


def cost_bound(two: DataFrame, k: int = PATHS_RANKED) -> DataFrame:
    """(pair_id, bound): the cost of the k-th cheapest two-hop path of pairs that have so many; a dearer path of three hops cannot rank."""
    return two.groupBy("pair_id").agg(F.count("*").alias("n"), F.max("cost").alias("bound")).filter(F.col("n") >= k).select("pair_id", "bound")


def rank_paths(f: Frontiers, k: int = PATHS_RANKED) -> DataFrame:
    """The k cheapest paths of each pair, of two hops or three."""
    two = checkpoint(top_rows(paths2(f), ["pair_id"], [F.expr(o) for o in _ORDER], k, "rank").drop("rank"))
    return cheapest(two.unionByName(paths3(f, k, cost_bound(two, k))), k)


def diversify(ranked: DataFrame, limit: int = PATHS_RETURNED, overlap: float = MAX_OVERLAP) -> DataFrame:
    """Per pair, walk the ranked paths and keep those whose middles differ enough from the kept ones.

    One pair holds at most the ranked sixty paths, folded in rank order by ``aggregate``.
    """
    middles = F.array_distinct(F.transform(
        F.slice("steps", F.lit(1), F.size("steps") - 1), lambda s: F.struct(s["node_type"], s["node_id"])))
    path = F.struct("rank", "len", "cost", "rarity", "steps", middles.alias("mids"))
    grouped = ranked.groupBy("pair_id").agg(F.array_sort(F.collect_list(path)).alias("paths"))

    def take(kept: Column, p: Column) -> Column:
        shared = lambda q: F.size(F.array_intersect(q["mids"], p["mids"]))
        alike = F.exists(kept, lambda q: shared(q) / F.least(F.size(q["mids"]), F.size(p["mids"])) > overlap)
        full = F.size(kept) >= limit
        return F.when(full | (F.size(p["mids"]) == 0) | alike, kept).otherwise(F.concat(kept, F.array(p)))

    none = F.filter("paths", lambda p: F.lit(False))
    kept = grouped.select("pair_id", F.posexplode(F.aggregate("paths", none, take)).alias("pos", "p"))
    return kept.select("pair_id", (F.col("pos") + 1).alias("place"), "p.rank", "p.len", "p.cost", "p.rarity", "p.steps")


def narrate_paths(paths: DataFrame, pairs: DataFrame, node: DataFrame, meta: DataFrame) -> DataFrame:
    """Each path as a sentence. Labels are looked up for the few nodes on kept paths only."""
    key = ["pair_id", "place"]
    narration = F.when(F.col("inverse"), F.coalesce("narration_inverse", "narration")).otherwise(
        F.coalesce("narration", "narration_inverse"))
    labels = node.select("node_type", F.col("id").alias("node_id"), F.col("label").alias("object_label"))
    templates = meta.select("predicate", "narration", "narration_inverse")
    steps = (
        paths.select(*key, F.posexplode("steps").alias("i", "s")).select(*key, "i", "s.*")
        .join(labels, ["node_type", "node_id"]).join(templates, "predicate", "left")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct(
            "i", narration.alias("template"), "label", "object_label", F.col("node_type").alias("object_type"))))
            .alias("told"))
    )
    starts = (
        pairs.select("pair_id", F.col("a_type").alias("node_type"), F.col("a_id").alias("node_id"))
        .join(labels, ["node_type", "node_id"]).select("pair_id", F.col("object_label").alias("from_label"))
    )
    return (
        paths.join(steps, key).join(starts, "pair_id")
        .filter(F.size("told") == F.col("len"))
        .withColumn("narration", narrate(F.col("from_label"), F.col("told")))
        .drop("told", "from_label")
    )


def find_paths(pairs: DataFrame, eb: DataFrame, degree: DataFrame, node: DataFrame, meta: DataFrame,
               limit: int = PATHS_RETURNED) -> DataFrame:
    """Why the two nodes of each pair are connected: up to ``limit`` diverse, narrated paths."""
    ranked = rank_paths(frontiers(pairs, eb, degree))
    return narrate_paths(diversify(ranked, limit), pairs, node, meta)
