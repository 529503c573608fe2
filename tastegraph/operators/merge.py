"""Reversible merges of duplicate entities, applied as a batch.

A merge map has (merged_id, surviving_id). What a merge moved is logged row by row, so reverting
joins on the log and no list of ids is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scalars import AsOf, timestamp
from tastegraph.plans.lineage import checkpoint
from tastegraph.tables import Tables

EDGE_KEY = ["subject_type", "subject_id", "predicate", "object_type", "object_id"]


def close_merges(merge_map: DataFrame) -> DataFrame:
    """Point every merged entity at its last survivor, following chains a → b → c.

    Each round doubles the distance covered, so a chain of n merges ends after ceil(log2(n)) rounds; what goes on longer
    is a cycle and refused.
    """
    current = checkpoint(merge_map.select("merged_id", "surviving_id").distinct())
    if current.filter(F.col("merged_id") == F.col("surviving_id")).limit(1).count():
        raise ValueError("an entity cannot be merged into itself")
    if current.groupBy("merged_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("an entity cannot be merged into two others")
    for _ in range(max(current.count(), 1).bit_length() + 1):
        onward = current.select(F.col("merged_id").alias("surviving_id"), F.col("surviving_id").alias("further"))
        stepped = checkpoint(current.join(onward, "surviving_id", "left"))
        if not stepped.filter(F.col("further").isNotNull()).limit(1).count():
            return current
        current = stepped.select("merged_id", F.coalesce("further", "surviving_id").alias("surviving_id"))
    raise ValueError("the merge map holds a cycle")


def _repoint(df: DataFrame, column: str, merge_map: DataFrame, when: Column | None = None) -> DataFrame:
    """Replace merged ids in a column; ``__moved`` tells whether this row changed."""
    m = merge_map.select(F.col("merged_id").alias(column), F.col("surviving_id").alias("__to"))
    joined = df.join(m, column, "left")
    hit = F.col("__to").isNotNull() if when is None else F.col("__to").isNotNull() & when
    return joined.withColumn("__moved", hit).withColumn(column, F.when(hit, F.col("__to")).otherwise(F.col(column))).drop("__to")


def _edges(edge: DataFrame, merge_map: DataFrame, entity_type: str) -> DataFrame:
    """Edges with both ends repointed, flags for each end, and whether they collide with a kept edge."""
    s = _repoint(edge.withColumns({"old_subject": F.col("subject_id"), "old_object": F.col("object_id")}), "subject_id",
                 merge_map, F.col("subject_type") == entity_type).withColumnRenamed("__moved", "moved_subject")
    o = _repoint(s, "object_id", merge_map, F.col("object_type") == entity_type).withColumnRenamed("__moved", "moved_object")
    moved = F.col("moved_subject") | F.col("moved_object")
    # an edge that was already there stays; among moved ones the first id
    touched = o.filter(moved).select(*EDGE_KEY).distinct()
    keep = o.join(touched, EDGE_KEY, "left_semi").groupBy(*EDGE_KEY).agg(
        F.min(F.struct(moved.alias("moved"), F.col("id"))).alias("keep"))
    return o.join(keep, EDGE_KEY, "left").withColumn(
        "collapsed", F.coalesce(moved & (F.col("keep.id") != F.col("id")), F.lit(False))).drop("keep")


def collapse_edges(edge: DataFrame, merge_map: DataFrame, entity_type: str = "title") -> DataFrame:
    """Edges that would repeat one the survivor has, with their ends as they were."""
    return _edges(edge, merge_map, entity_type).filter("collapsed").select(
        "id", "subject_type", F.col("old_subject").alias("subject_id"), "predicate", "object_type",
        F.col("old_object").alias("object_id"))


def apply_merges(t: Tables, merge_map: DataFrame, entity_type: str = "title") -> Tables:
    """The tables after the merges: ends repointed, collisions collapsed, merged entities gone."""
    m = close_merges(merge_map)
    owner = "person_id" if entity_type == "person" else "title_id"
    credit = _repoint(t.credit, owner, m).drop("__moved")
    edges = _edges(t.edge, m, entity_type).filter(~F.col("collapsed")).select(*t.edge.columns)
    external = _repoint(t.external_id, "entity_id", m, F.col("entity_type") == entity_type).drop("__moved")
    entity = getattr(t, entity_type)
    kept = entity.join(m.select(F.col("merged_id").alias("id")), "id", "left_anti")
    frames = {"credit": credit.select(*t.credit.columns), "edge": edges,
              "external_id": external.select(*t.external_id.columns), entity_type: kept}
    if entity_type == "title":
        frames["season"] = _repoint(t.season, "title_id", m).drop("__moved").select(*t.season.columns)
        frames["episode"] = _repoint(t.episode, "title_id", m).drop("__moved").select(*t.episode.columns)
    alias = entity.join(m.select(F.col("merged_id").alias("id"), "surviving_id"), "id").select(
        F.lit(entity_type).alias("entity_type"), F.col("surviving_id").alias("entity_id"),
        F.col("title" if entity_type == "title" else "name").alias("alias"), F.lit("merged_from").alias("alias_type"))
    frames["entity_alias"] = t.entity_alias.unionByName(alias) if "entity_alias" in t else alias
    return t.replace(**frames)


def merge_moves(t: Tables, merge_map: DataFrame, entity_type: str = "title") -> DataFrame:
    """Everything the merges move: (merged_id, surviving_id, what, item)."""
    return _moves(t, close_merges(merge_map), entity_type)


def _moves(t: Tables, m: DataFrame, entity_type: str) -> DataFrame:
    """What a closed map moves."""
    owner = "person_id" if entity_type == "person" else "title_id"
    ids = m.select(F.col("merged_id").alias("__id"), "merged_id", "surviving_id")

    def moves(df: DataFrame, on: str, what: str, item: Column) -> DataFrame:
        return df.withColumn("__id", F.col(on)).join(ids, "__id").select("merged_id", "surviving_id", F.lit(what).alias("what"), item.alias("item"))

    edges = _edges(t.edge, m, entity_type).filter(~F.col("collapsed"))
    frames = [
        moves(t.credit, owner, "credit", F.col("id").cast("string")),
        moves(edges.filter("moved_subject"), "old_subject", "subject_edge", F.col("id").cast("string")),
        moves(edges.filter("moved_object"), "old_object", "object_edge", F.col("id").cast("string")),
        moves(t.external_id.filter(F.col("entity_type") == entity_type), "entity_id", "external_id",
              F.concat_ws("\t", "source", "source_id")),
    ]
    if entity_type == "title":
        frames.append(moves(t.season, "title_id", "season", F.col("id").cast("string")))
        frames.append(moves(t.episode, "title_id", "episode", F.col("id").cast("string")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def merge_log(t: Tables, merge_map: DataFrame, as_of: AsOf, entity_type: str = "title", reason: str = "duplicate") -> DataFrame:
    """One row per merge: snapshot of the merged entity, how much moved, how much collapsed."""
    m = close_merges(merge_map)
    entity = getattr(t, entity_type)
    snapshot = F.to_json(F.struct(*entity.columns), {"ignoreNullFields": "false"})
    name = "title" if entity_type == "title" else "name"
    merged = entity.select(F.col("id").alias("merged_id"), snapshot.alias("snapshot"), F.col(name).alias("display_name"))
    moved = _moves(t, m, entity_type).filter(~F.col("what").isin("external_id", "season", "episode")).groupBy(
        "merged_id").agg(F.count("*").alias("repointed"))
    # ids of other kinds of entity may equal a merged one's
    ends = [F.when(F.col(f"{end}_type") == entity_type, F.col(f"{end}_id")) for end in ("subject", "object")]
    gone = collapse_edges(t.edge, m, entity_type).select(F.explode(F.array_distinct(F.array(*ends))).alias("merged_id")).join(
        m.select("merged_id"), "merged_id").groupBy("merged_id").agg(F.count("*").alias("collapsed"))
    return (
        m.join(merged, "merged_id").join(moved, "merged_id", "left").join(gone, "merged_id", "left")
        .select(F.lit(entity_type).alias("entity_type"), "merged_id", "surviving_id", F.lit(reason).alias("reason"), "snapshot",
                "display_name", F.coalesce("repointed", F.lit(0)).alias("repointed"), F.coalesce("collapsed", F.lit(0)).alias("collapsed"),
                timestamp(as_of).alias("merged_at"), F.lit(None).cast("timestamp").alias("reverted_at"))
    )


def revert_merges(t: Tables, log: DataFrame, moves: DataFrame, merged_ids: DataFrame, as_of: AsOf,
                  entity_type: str = "title") -> tuple[Tables, DataFrame]:
    """Undo merges: restore the snapshots and move back exactly what the log says moved.

    Collapsed edges stay gone. Returns the tables and the log with the revert stamped on it.
    """
    wanted = merged_ids.select("merged_id").distinct()
    undo = log.join(wanted, "merged_id", "left_semi")
    if undo.filter(F.col("reverted_at").isNotNull()).limit(1).count():
        raise ValueError("a merge can be reverted only once")
    if wanted.join(undo.select("merged_id"), "merged_id", "left_anti").limit(1).count():
        raise ValueError("no such merge")
    back = moves.join(wanted, "merged_id", "left_semi")
    owner = "person_id" if entity_type == "person" else "title_id"

    def restore(df: DataFrame, what: str, column: str, key: Column) -> DataFrame:
        b = back.filter(F.col("what") == what).select(F.col("item").alias("__item"), F.col("merged_id").alias("__back"))
        return df.withColumn("__item", key).join(b, "__item", "left").withColumn(
            column, F.coalesce("__back", column)).select(*df.columns)

    edge = restore(t.edge, "subject_edge", "subject_id", F.col("id").cast("string"))
    edge = restore(edge, "object_edge", "object_id", F.col("id").cast("string"))
    external = t.external_id.withColumn("__k", F.when(F.col("entity_type") == entity_type, F.concat_ws("\t", "source", "source_id")))
    frames = {
        "credit": restore(t.credit, "credit", owner, F.col("id").cast("string")), "edge": edge,
        "external_id": restore(external, "external_id", "entity_id", F.col("__k")).drop("__k"),
    }
    if entity_type == "title":
        frames["season"] = restore(t.season, "season", "title_id", F.col("id").cast("string"))
        frames["episode"] = restore(t.episode, "episode", "title_id", F.col("id").cast("string"))
    entity = getattr(t, entity_type)
    restored = undo.select(F.from_json("snapshot", entity.schema).alias("s")).select("s.*")
    frames[entity_type] = entity.unionByName(restored)
    if "entity_alias" in t:
        old = undo.select(F.lit(entity_type).alias("entity_type"), F.col("surviving_id").alias("entity_id"),
                          F.col("display_name").alias("alias"), F.lit("merged_from").alias("alias_type"))
        frames["entity_alias"] = t.entity_alias.join(old, ["entity_type", "entity_id", "alias", "alias_type"], "left_anti")
    flag = wanted.withColumn("__undone", F.lit(True))
    stamped = log.join(flag, "merged_id", "left").withColumn(
        "reverted_at", F.when(F.col("__undone"), timestamp(as_of)).otherwise(F.col("reverted_at"))).drop("__undone").select(*log.columns)
    return t.replace(**frames), stamped
