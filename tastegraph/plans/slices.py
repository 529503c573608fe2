"""Ordered neighbours and ranks inside groups of any size.

A window over a whole group sorts that group in one task. When one key may hold a third of all rows,
the group is cut into slices by an order-preserving expression (a day, a range of ids): rows are
windowed inside their slice, and a summary with one row per slice carries what crosses its borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_slice(ts: Column, seconds: int) -> Column:
    """Order-preserving slice number of a timestamp."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000))


def _packed(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def with_neighbour(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column, name: str,
                   forward: bool) -> DataFrame:
    """Add ``name``: ``value`` of the row after (or before) each row of its group, NULL at the end."""
    d = df.withColumns({"__slice": slice_by, "__value": value, "__order": _packed(order)})
    inside = Window.partitionBy(*keys, "__slice").orderBy("__order")
    across = Window.partitionBy(*keys).orderBy("__slice")
    edge_of = F.min_by if forward else F.max_by
    shift = F.lead if forward else F.lag
    # values travel in a struct, so that a NULL value is not taken for a missing row
    boxed = F.struct(F.col("__value").alias("v"))
    borders = (
        d.groupBy(*keys, "__slice").agg(edge_of(boxed, F.col("__order")).alias("__edge"))
        .select(*keys, "__slice", shift("__edge").over(across).alias("__beyond"))
    )
    return (
        d.withColumn("__near", shift(boxed).over(inside))
        .join(borders, [*keys, "__slice"])
        .withColumn(name, F.coalesce("__near", "__beyond")["v"])
        .drop("__slice", "__value", "__order", "__near", "__beyond")
    )


def with_next(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """``value`` of the following row."""
    return with_neighbour(df, keys, slice_by, order, value, name, forward=True)


def with_previous(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """``value`` of the preceding row."""
    return with_neighbour(df, keys, slice_by, order, value, name, forward=False)


def with_rank(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place in its group, from 1."""
    d = df.withColumns({"__slice": slice_by, "__order": _packed(order)})
    inside = Window.partitionBy(*keys, "__slice").orderBy("__order")
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
        .select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        d.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, [*keys, "__slice"])
        .withColumn(name, F.col("__rn") + F.col("__offset"))
        .drop("__slice", "__order", "__rn", "__offset")
    )


def with_last_seen(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the latest non-NULL ``value`` of the group up to and including this row."""
    d = df.withColumns({"__slice": slice_by, "__value": value, "__order": _packed(order)})
    inside = Window.partitionBy(*keys, "__slice").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("__value").isNotNull(), F.col("__order"))
    carried = (
        d.groupBy(*keys, "__slice").agg(F.max_by("__value", known).alias("__latest"))
        .select(*keys, "__slice", F.last("__latest", ignorenulls=True).over(before).alias("__before"))
    )
    return (
        d.withColumn("__here", F.last("__value", ignorenulls=True).over(inside))
        .join(carried, [*keys, "__slice"])
        .withColumn(name, F.coalesce("__here", "__before"))
        .drop("__slice", "__value", "__order", "__here", "__before")
    )
