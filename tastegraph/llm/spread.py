"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.plans.lineage import checkpoint

#: A key with more than one in so many rows is joined by broadcast; there are fewer such keys than this number, at any size.
SHARE = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, share: int = SHARE) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row a key with ``n``, its number of rows in ``rows``.

    Keys that hold more than 1 / ``share`` of the rows meet them where they lie, so no task gathers one key's rows; there are at most
    ``share`` of these. All other keys meet theirs in a shuffle. Rows whose key is not in ``keyed`` or is NULL go, as in an inner join.
    ``rows`` is read twice and should be a stored table.
    """
    keyed = checkpoint(keyed)
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = keyed.where(F.col(n) * share > total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(n) * share <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
