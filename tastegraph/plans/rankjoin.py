"""The strongest partners of every row by what two rows share, on either side of it in id order, without pairing all that share a key.

Rows are (id, held), ``held`` an array of struct(key, pooled, weight, value). A shared key adds weight * value * value; *pooled* keys add
weight * least value and count only from the second one on. Rows are cut into groups by ranges of id. A group first meets itself, the group
after it and the very first, where ties go. Of any other group it sees the greatest value of each key they share: this bounds what a row can score there, and
only groups that can still give some row a partner are sent and met. Before a block of rows is joined it is bounded in the same way; rows with the same
common keys lie side by side, so blocks differ in what they can add and most are left out. What is sent grows with the rows where alike rows
have ids close by or the keys they share far off are too common to beat those nearby; else with the groups that share something better.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.plans.lineage import checkpoint

#: Rows of a group, tasks a group's further meetings are dealt to, rows of a block, and cells of a score table a task holds at once.
GROUP, STRIPES, BLOCK, CELLS = 4096, 8, 256, 1_000_000
DIGITS = 9
ASKING, KNOWN, ASKED, FAR = range(4)
_SIDES = ("before", "after")


class _Rows:
    """Rows with their keys laid end to end."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        held = batch.column("held")
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        lengths = np.diff(held.offsets.to_numpy())
        flat = held.flatten()
        self.owner = np.repeat(np.arange(len(self.ids)), lengths)
        self.key, self.pooled, self.weight, self.value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "pooled", "weight", "value"))


class _Block:
    """Rows in id order, and what each key's holders are."""

    def __init__(self, rows: _Rows) -> None:
        order = np.argsort(rows.ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = rows.ids[order]
        by_key = np.lexsort((place[rows.owner], rows.key))
        self.place, self.value = place[rows.owner][by_key], rows.value[by_key]
        self.keys, self.start, self.count = np.unique(rows.key[by_key], return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(self.value, self.start) if len(self.start) else self.value


class _Group:
    """Rows that look for partners, with the k strongest found so far on either side."""

    def __init__(self, parts: list[_Rows], k: int) -> None:
        sizes = np.cumsum([0, *[len(p.ids) for p in parts]])
        self.ids = np.concatenate([p.ids for p in parts])
        self.owner = np.concatenate([p.owner + s for p, s in zip(parts, sizes, strict=False)])
        self.key, self.pooled, self.weight, self.value = (np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "pooled", "weight", "value"))
        self.score = {side: np.full((len(self.ids), k), -np.inf) for side in _SIDES}
        self.partner = {side: np.full((len(self.ids), k), np.iinfo(np.int64).max) for side in _SIDES}

    def _shared(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the group's keys are among ``keys``, and where there."""
        at = np.minimum(np.searchsorted(keys, self.key), max(0, len(keys) - 1))
        shared = np.flatnonzero(keys[at] == self.key) if len(keys) else np.empty(0, np.int64)
        return shared, at[shared]

    def _open(self, shared: np.ndarray, most: np.ndarray, low: int, high: int) -> np.ndarray:
        """Rows that may find a partner among ids from low to high, if these hold the shared keys with at most the values ``most``."""
        n, owner, weight, value, pooled = len(self.ids), self.owner[shared], self.weight[shared], self.value[shared], self.pooled[shared]
        most = np.maximum(0.0, weight * np.where(pooled, np.minimum(value, most), value * most))
        # one pooled key alone counts for nothing
        enough = np.bincount(owner[pooled], minlength=n) >= 2
        plain = np.bincount(owner[~pooled], minlength=n) > 0
        bound = np.round(np.bincount(owner[~pooled], most[~pooled], n) + np.where(enough, np.bincount(owner[pooled], most[pooled], n), 0.0), DIGITS)
        open_ = np.zeros(len(self.ids), bool)
        for side, there in (("before", low < self.ids), ("after", high > self.ids)):
            last, tie = self.score[side][:, -1], self.partner[side][:, -1]
            nearest = low if side == "before" else np.maximum(low, self.ids)
            open_ |= there & ((bound > last) | (bound == last) & (nearest < tie))
        return open_ & (plain | enough)

    def may_gain(self, keys: np.ndarray, most: np.ndarray, low: int, high: int) -> bool:
        """Whether rows with these keys and ids could give some row of the group a partner."""
        order = np.argsort(keys)
        shared, at = self._shared(keys[order])
        return bool(self._open(shared, most[order][at], low, high).any())

    def recall(self, part: pa.RecordBatch) -> None:
        """Take up what the group's rows have found before."""
        order = np.argsort(self.ids)
        place = order[np.searchsorted(self.ids[order], part.column("id").to_numpy(zero_copy_only=False))]
        for side in _SIDES:
            lengths = np.diff(part.column(side).offsets.to_numpy())
            flat = part.column(side).flatten()
            row = np.repeat(place, lengths)
            rank = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.score[side][row, rank] = -flat.field("s").to_numpy(zero_copy_only=False)
            self.partner[side][row, rank] = flat.field("id").to_numpy(zero_copy_only=False)

    def meet(self, block: _Block) -> None:
        """Take in the partners that the block holds."""
        n = len(block.ids)
        shared, at = self._shared(block.keys)
        open_ = self._open(shared, block.most[at], block.ids[0], block.ids[-1])
        owner, weight, value, pooled = self.owner[shared], self.weight[shared], self.value[shared], self.pooled[shared]
        chosen = np.flatnonzero(open_)
        step = max(1, CELLS // n)
        local = np.full(len(self.ids), -1)
        for s in range(0, len(chosen), step):
            mine = chosen[s : s + step]
            local[:] = -1
            local[mine] = np.arange(len(mine))
            keep = np.flatnonzero(local[owner] >= 0)
            score = _scores(block, local[owner[keep]], at[keep], weight[keep], value[keep], pooled[keep], len(mine))
            for side in _SIDES:
                self.take(side, mine, block.ids, score)

    def take(self, side: str, mine: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge a score table, columns in id order, into the k strongest of the side; ties go to the smaller id."""
        known, partner = self.score[side], self.partner[side]
        k = known.shape[1]
        # from the columns before, or after, each row's own id
        edge = np.searchsorted(ids, self.ids[mine], "left" if side == "before" else "right")[:, None]
        columns = np.arange(len(ids))[None, :]
        good = (score >= known[mine, -1:]) & (score > -np.inf) & (columns < edge if side == "before" else columns >= edge)
        if np.count_nonzero(good) > 8 * k * len(mine) and len(ids) > k:
            score = np.where(good, score, -np.inf)
            least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None]
            above, equal = score > least, good & (score == least)
            good = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
        row, column = np.nonzero(good)
        if not len(row):
            return
        rows, row_at = np.unique(row, return_inverse=True)
        mine = mine[rows]
        owner = np.concatenate([np.repeat(np.arange(len(mine)), k), row_at])
        value = np.concatenate([known[mine].ravel(), score[row, column]])
        other = np.concatenate([partner[mine].ravel(), ids[column]])
        order = np.lexsort((other, -value, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        first = order[rank < k]
        known[mine], partner[mine] = value[first].reshape(-1, k), other[first].reshape(-1, k)


def _scores(block: _Block, row: np.ndarray, at: np.ndarray, weight: np.ndarray, value: np.ndarray, pooled: np.ndarray, rows: int) -> np.ndarray:
    """Score of every row with every row of the block, rounded; -inf where nothing is shared that counts."""
    n, count = len(block.ids), block.count[at]
    total, counts = None, None
    for pool in (False, True):
        these = np.flatnonzero(pooled == pool)
        if not len(these):
            continue
        times = count[these]
        which = np.repeat(these, times)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(block.start[at[these]], times)
        theirs, own = block.value[place], value[which]
        cell = row[which] * n + block.place[place]
        worth = weight[which] * (np.minimum(own, theirs) if pool else own * theirs)
        add = np.bincount(cell, worth, rows * n)
        if pool:
            held = np.bincount(cell, minlength=rows * n) >= 2
            add *= held
        else:
            held = add > 0 if (worth > 0).all() else np.bincount(cell, minlength=rows * n) > 0
        total, counts = (add, held) if total is None else (total + add, counts | held)
    if total is None:
        return np.full((rows, n), -np.inf)
    score = np.round(total, DIGITS, out=total)
    score[~counts] = -np.inf
    return score.reshape(rows, n)


_HELD = "array<struct<key: long, pooled: boolean, weight: double, value: double>>"
_PAIRS = "array<struct<s: double, id: long>>"
_SENT = {"unit": "int", "g": "int", "kind": "int", "p": "int", "like": "array<long>", "id": "long", "high": "long", "held": _HELD, "before": _PAIRS, "after": _PAIRS}


def _sent(df: DataFrame, kind: int, unit: Column) -> DataFrame:
    """Rows as they are sent to the task of a unit: what a kind of row does not have is NULL."""
    d = df.withColumns({"kind": F.lit(kind), "unit": unit})
    return d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in _SENT.items()])


def _met(sent: list[DataFrame], units: int, k: int) -> DataFrame:
    """(g, ask, id, before, after): what the groups' rows have found, or with ``ask`` a group to be met still."""
    ordered = reduce(DataFrame.unionByName, sent).repartition(units, "unit").sortWithinPartitions("unit", "kind", "p", "like", "id").drop("like")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, number, parts, group, asks = None, None, [], None, []

        def told() -> Iterator[pa.RecordBatch]:
            sides = []
            for side in _SIDES:
                score, partner = group.score[side], group.partner[side]
                real = score > -np.inf
                pair = pa.StructArray.from_arrays([pa.array(-score[real]), pa.array(partner[real])], ["s", "id"])
                sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]), pa.int32()), pair))
            n, names = len(group.ids), ["g", "ask", "id", *_SIDES]
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(group.ids), *sides], names)
            if asks:
                n = len(asks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int32()), pa.array(asks, pa.int32()), pa.nulls(n, pa.int64()), *[pa.nulls(n, s.type) for s in sides]], names)

        for batch in batches:
            for part in _cut(batch):
                here, kind = part.column("unit")[0].as_py(), part.column("kind")[0].as_py()
                if here != unit:
                    if group is not None:
                        yield from told()
                    unit, number, parts, group, asks = here, part.column("g")[0].as_py(), [], None, []
                if kind == ASKING:
                    parts.append(_Rows(part))
                    continue
                if group is None:
                    if not parts:
                        continue
                    group, parts = _Group(parts, k), []
                if kind == KNOWN:
                    group.recall(part)
                elif kind == ASKED:
                    group.meet(_Block(_Rows(part)))
                else:
                    for at in range(part.num_rows):
                        row = part.slice(at, 1)
                        rows = _Rows(row)
                        if group.may_gain(rows.key, rows.value, rows.ids[0], row.column("high")[0].as_py()):
                            asks.append(row.column("p")[0].as_py())
        if group is not None:
            yield from told()

    return ordered.mapInArrow(run, f"g int, ask int, id long, before {_PAIRS}, after {_PAIRS}")


def strongest_partners(rows: DataFrame, k: int) -> DataFrame:
    """(id, partner): the k strongest partners of each row of (id, held) before it and after it, ties to the smaller id."""
    return strongest_lists(rows, k).select("id", F.explode(F.concat("before.id", "after.id")).alias("partner"))


def strongest_lists(rows: DataFrame, k: int) -> DataFrame:
    """(id, before, after): ``strongest_partners`` as lists of (score with its sign turned, partner), best first.

    A task holds one group and one block; what leaves it is one row for each row of the group, so results grow with the rows alone.
    Rows without keys have no partners.
    """
    rows = rows.filter(F.size("held") > 0)
    groups = max(1, -(-rows.count() // GROUP))
    # keys of the least weight are the commonest: rows alike in these lie side by side
    lightest = F.array_sort(F.transform("held", lambda h: F.struct(h["weight"].alias("w"), h["key"].alias("key"))))
    placed = checkpoint(rows.repartitionByRange(groups, "id").select(
        F.spark_partition_id().alias("g"), "id", F.transform(F.slice(lightest, 1, 4), lambda s: s["key"]).alias("like"), "held"))
    span = placed.groupBy("g").agg(F.min("id").alias("id"), F.max("id").alias("high"))
    last = span.agg(F.max("g")).first()[0] or 0
    most = placed.select("g", F.explode("held").alias("h")).groupBy("g", "h.key").agg(F.max("h.value").alias("value"))
    p = F.col("p")
    told = most.join(most.withColumnRenamed("g", "p").withColumnRenamed("value", "most"), "key").filter((p != 0) & (p != F.col("g")) & (p != F.col("g") + 1))
    entry = F.struct("key", F.lit(False).alias("pooled"), F.lit(0.0).alias("weight"), F.col("most").alias("value"))
    far = told.groupBy("g", "p").agg(F.collect_list(entry).alias("held")).join(span.withColumnRenamed("g", "p"), "p")
    by_group = placed.withColumnRenamed("g", "p")
    near = by_group.withColumn("g", F.explode(F.when(p == 0, F.sequence(F.lit(0), F.lit(last))).otherwise(F.array(p - 1, p))))
    met = checkpoint(_met([_sent(placed, ASKING, F.col("g")), _sent(near, ASKED, F.col("g")), _sent(far, FAR, F.col("g"))], groups, k))
    found = met.filter(F.col("ask").isNull())
    asks = met.filter(F.col("ask").isNotNull()).select("g", F.col("ask").alias("p"), (F.col("g") * STRIPES + F.col("ask") % STRIPES).alias("u"))
    if asks.limit(1).count():
        units = asks.select("g", "u").distinct()
        further = _met([_sent(placed.join(units, "g"), ASKING, F.col("u")), _sent(found.join(units, "g"), KNOWN, F.col("u")),
                        _sent(by_group.join(asks, "p"), ASKED, F.col("u"))], groups, k)
        # the k first of what the tasks hold, each with what was known before
        found = found.unionByName(further).groupBy("id").agg(
            *[F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(side)))), 1, k).alias(side) for side in _SIDES])
    return found.select("id", *_SIDES)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of up to a block's rows with one unit, kind and group met."""
    marks = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("unit", "kind", "p")])
    cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, BLOCK):
            yield batch.slice(at, min(BLOCK, b - at))
