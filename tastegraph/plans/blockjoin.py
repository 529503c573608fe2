"""Strongest partners with their scores: rare keys are met in blocks of ids, common ones by the rank join.

Rows are (id, held), ``held`` an array of struct(key, pooled, weight, value, signal, mark). A shared key adds what ``plans/rankjoin.py``
says to its signal; a pair's reason is its strongest signal, by the greatest mark of the keys shared there. Ids are cut into blocks, and two
blocks that hold a rare key in common meet in one task, so what is sent grows with rows times blocks and no pair is ever joined to what its rows
hold. Beside a rare key a pair's common keys are added by the ways in which rows hold these. Partners that share common keys alone are taken way by
way, each way known by its first ids in every block; where rows hold common keys in too many ways they come from the rank join. What is
said there of a pair with a rare key is too little, and such a pair was ranked in full before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.plans import rankjoin
from tastegraph.plans.lineage import written

#: Rows of a block, blocks of a small input and their least rows, pairs a task looks at at once, cells of a table of common keys.
BLOCK, FEW, LEAST, CELLS, TABLE = 131_072, 8, 2_048, 1_000_000, 8_000_000
#: Ways of holding common keys that are looked at one by one.
WAYS = 4_096
#: A key is common if more rows hold it than the first and than one in the second.
COMMON, SHARE = 1_024, 128
DIGITS = rankjoin.DIGITS
_LOW, _HIGH, _BOTH = range(3)
_ROW, _HEAD, _WAY = range(3)

HELD = "array<struct<key: long, pooled: boolean, weight: double, value: double, signal: int, mark: int>>"
_FIELDS = ("key", "pooled", "weight", "value", "signal", "mark")
_FOUND = "array<struct<s: double, id: long, r: int>>"


class _Keys:
    """Keys of rows, laid end to end."""

    def __init__(self, owner: np.ndarray, *columns: np.ndarray) -> None:
        self.owner = owner
        for name, column in zip(_FIELDS, columns, strict=True):
            setattr(self, name, column)

    def take(self, which: np.ndarray, owner: np.ndarray | None = None) -> _Keys:
        return _Keys(self.owner[which] if owner is None else owner, *(getattr(self, f)[which] for f in _FIELDS))


def _keys(lists: pa.Array) -> _Keys:
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return _Keys(owner, *(flat.field(f).to_numpy(zero_copy_only=False) for f in _FIELDS))


def _joined(parts: list[_Keys], sizes: np.ndarray) -> _Keys:
    return _Keys(np.concatenate([p.owner + s for p, s in zip(parts, sizes, strict=False)]), *(np.concatenate([getattr(p, f) for p in parts]) for f in _FIELDS))


class _Half:
    """One block in id order: rare keys of its rows, and the ways in which they hold common ones."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = [b.filter(pc.is_valid(b.column("id"))) for b in batches]
        ids = np.concatenate([b.column("id").to_numpy(zero_copy_only=False) for b in rows])
        sizes = np.cumsum([0, *[b.num_rows for b in rows]])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = ids[order]
        rare = _joined([_keys(b.column("rare")) for b in rows], sizes)
        owner = place[rare.owner]
        in_order = np.argsort(owner, kind="stable")
        self.rare = rare.take(in_order, owner[in_order])
        ways, self.common = _ways([b.filter(pc.is_null(b.column("id"))) for b in batches])
        self.ways = len(ways)
        self.way = np.searchsorted(ways, np.concatenate([b.column("way").to_numpy(zero_copy_only=False) for b in rows])[order])


def _ways(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, _Keys]:
    """Ways in order, and the keys held in each."""
    sizes = np.cumsum([0, *[b.num_rows for b in batches]])
    ways, at = np.unique(np.concatenate([b.column("way").to_numpy(zero_copy_only=False) for b in batches]), return_inverse=True)
    common = _joined([_keys(b.column("common")) for b in batches], sizes)
    return ways, common.take(np.arange(len(common.key)), at[common.owner])


class _Totals:
    """What pairs share: a sum and the greatest mark for each signal, and how many pooled keys."""

    def __init__(self, signals: int, n: int) -> None:
        self.sums, self.marks, self.pooled = np.zeros((signals, n)), np.full((signals, n), -1, np.int8), np.zeros(n, np.int32)

    def add(self, other: _Totals, at: np.ndarray | slice) -> None:
        self.sums += other.sums[:, at]
        np.maximum(self.marks, other.marks[:, at], out=self.marks)
        self.pooled += other.pooled[at]


def _worth(keys: _Keys, which: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    own, pooled = keys.value[which], keys.pooled[which]
    return keys.weight[which] * (np.where(pooled, np.minimum(own, theirs), own * theirs) if pooled.any() else own * theirs)


def _summed(keys: _Keys, which: np.ndarray, worth: np.ndarray, order: np.ndarray, start: np.ndarray, signals: int) -> _Totals:
    """Totals of pairs, each a run of shared keys in the given order."""
    out = _Totals(signals, len(start))
    which, worth = which[order], worth[order]
    signal, mark = keys.signal[which], keys.mark[which]
    for s in np.unique(signal):
        mine = signal == s
        out.sums[s] = np.add.reduceat(np.where(mine, worth, 0.0), start)
        out.marks[s] = np.maximum.reduceat(np.where(mine, mark, -1), start)
    pooled = keys.pooled[which]
    if pooled.any():
        out.pooled = np.add.reduceat(pooled.astype(np.int32), start)
    return out


def _starts(code: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)


class _Common:
    """What the ways of one block share with those of another."""

    def __init__(self, low: _Keys, low_ways: int, high: _Keys, high_ways: int, signals: int) -> None:
        self.signals, self.low_ways, self.high_ways = signals, low_ways, high_ways
        self.keys, self.table = [], None
        for key in np.intersect1d(low.key, high.key):
            a, b = low.take(np.flatnonzero(low.key == key)), high.take(np.flatnonzero(high.key == key))
            mine, theirs = np.full(low_ways, np.nan), np.full(high_ways, np.nan)
            mine[a.owner], theirs[b.owner] = a.value, b.value
            self.keys.append((mine, theirs, a.weight[0], bool(a.pooled[0]), int(a.signal[0]), int(a.mark[0])))

    def met(self, a: np.ndarray, b: np.ndarray) -> _Totals:
        out = _Totals(self.signals, len(a))
        for mine, theirs, weight, pooled, signal, mark in self.keys:
            x, y = mine[a], theirs[b]
            both = ~(np.isnan(x) | np.isnan(y))
            out.sums[signal] += np.where(both, weight * (np.minimum(x, y) if pooled else x * y), 0.0)
            np.maximum(out.marks[signal], np.where(both, mark, -1).astype(np.int8), out=out.marks[signal])
            out.pooled += both & pooled
        return out

    def add_to(self, totals: _Totals, a: np.ndarray, b: np.ndarray) -> None:
        if not self.keys:
            return
        if self.low_ways * self.high_ways > TABLE:
            totals.add(self.met(a, b), slice(None))
            return
        if self.table is None:
            self.table = self.met(np.repeat(np.arange(self.low_ways), self.high_ways), np.tile(np.arange(self.high_ways), self.low_ways))
        totals.add(self.table, a * self.high_ways + b)


class Judge:
    """Score and reason of totals. ``reasons`` gives each signal's reasons by mark, ``pooled`` the signals of pooled keys, ``fixed`` strengths that stand for a signal's sum."""

    def __init__(self, reasons: Sequence[Sequence[str]], pooled: Sequence[int] = (), fixed: dict[int, float] | None = None) -> None:
        self.names = sorted({name for by_mark in reasons for name in by_mark})
        self.codes = [np.array([self.names.index(name) for name in by_mark]) for by_mark in reasons]
        self.signals, self.pooled, self.fixed = len(reasons), list(pooled), fixed or {}

    def score(self, totals: _Totals) -> np.ndarray:
        """Rounded scores, -inf where nothing is shared that counts; sums that do not count are dropped."""
        if self.pooled:
            alone = totals.pooled < 2
            totals.sums[np.ix_(self.pooled, np.flatnonzero(alone))] = 0.0
            totals.marks[np.ix_(self.pooled, np.flatnonzero(alone))] = -1
        score = np.round(totals.sums.sum(axis=0), DIGITS)
        score[(totals.marks < 0).all(axis=0)] = -np.inf
        return score

    def reason(self, totals: _Totals, which: np.ndarray) -> np.ndarray:
        """Of the strongest signals the first reason by name."""
        best, code = np.full(len(which), -np.inf), np.full(len(which), len(self.names), np.int32)
        for s in range(self.signals):
            mark = totals.marks[s, which]
            strength = np.where(mark >= 0, self.fixed[s] if s in self.fixed else np.round(totals.sums[s, which], DIGITS), -np.inf)
            named = self.codes[s][np.maximum(mark, 0)]
            wins = (strength > best) | (strength == best) & (mark >= 0) & (named < code)
            best, code = np.where(wins, strength, best), np.where(wins, named, code).astype(np.int32)
        return code

    def named(self, code: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in self.names]), code + 1)


def _first(owner: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The k greatest scores of each owner, ties to the smaller other; owners in order."""
    order = np.lexsort((other, -score, owner))
    sorted_owner = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner) < k]


def _meet(low: _Half, high: _Half, same: bool, k: int, judge: Judge) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(side, id, score, partner, reason) in id order: partners after the rows of the lower block and before those of the higher one."""
    by_key = np.argsort(high.rare.key, kind="stable")
    place, value = high.rare.owner[by_key], high.rare.value[by_key]
    keys, start, count = np.unique(high.rare.key[by_key], return_index=True, return_counts=True)
    if not len(keys):
        return
    at = np.minimum(np.searchsorted(keys, low.rare.key), len(keys) - 1)
    shared = np.flatnonzero(keys[at] == low.rare.key)
    mine, at = low.rare.take(shared), at[shared]
    common = _Common(low.common, low.ways, high.common, high.ways, judge.signals)
    times, n = count[at], len(high.ids)
    met = np.cumsum(times)
    known = np.full((n, k), -np.inf)
    partner, reason = np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int32)
    # whole rows of the lower block, so many that the pairs stay bounded
    ends = np.flatnonzero(np.concatenate([mine.owner[1:] != mine.owner[:-1], [True]])) + 1 if len(at) else np.empty(0, np.int64)
    cuts = [0]
    while cuts[-1] < len(at):
        done = met[cuts[-1] - 1] if cuts[-1] else 0
        reached = ends[ends <= np.searchsorted(met, done + CELLS, "right")]
        cuts.append(int(reached[-1]) if len(reached) and reached[-1] > cuts[-1] else int(ends[np.searchsorted(ends, cuts[-1], "right")]))
    for a, b in pairwise(cuts):
        many = times[a:b]
        which = np.repeat(np.arange(a, b), many)
        theirs = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[at[a:b]], many)
        if same:
            ahead = place[theirs] > mine.owner[which]
            which, theirs = which[ahead], theirs[ahead]
        if not len(which):
            continue
        code = mine.owner[which] * n + place[theirs]
        order = np.argsort(code, kind="stable")
        code = code[order]
        runs = _starts(code)
        totals = _summed(mine, which, _worth(mine, which, value[theirs]), order, runs, judge.signals)
        x, y = np.divmod(code[runs], n)
        common.add_to(totals, low.way[x], high.way[y])
        score = judge.score(totals)
        counted = score > -np.inf
        kept = np.flatnonzero(counted)
        kept = kept[_first(x[kept], score[kept], y[kept], k)]
        yield "after", low.ids[x[kept]], score[kept], high.ids[y[kept]], judge.reason(totals, kept)
        # earlier rows win ties, so a later one must score more
        better = np.flatnonzero(counted & (score > known[y, -1]))
        if not len(better):
            continue
        rows, row_at = np.unique(y[better], return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(rows)), k), row_at])
        scores = np.concatenate([known[rows].ravel(), score[better]])
        others = np.concatenate([partner[rows].ravel(), low.ids[x[better]]])
        reasons = np.concatenate([reason[rows].ravel(), judge.reason(totals, better)])
        first = _first(owner, scores, others, k)
        known[rows], partner[rows], reason[rows] = (v[first].reshape(-1, k) for v in (scores, others, reasons))
    real = known > -np.inf
    yield "before", np.repeat(high.ids, real.sum(axis=1)), known[real], partner[real], reason[real]


def _told(side: str, ids: np.ndarray, score: np.ndarray, partner: np.ndarray, reason: np.ndarray) -> pa.RecordBatch:
    start = _starts(ids)
    found = pa.StructArray.from_arrays([pa.array(-score), pa.array(partner), pa.array(reason, pa.int32())], ["s", "id", "r"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)), pa.int32()), found)
    none = pa.nulls(len(start), lists.type)
    sides = {s: lists if s == side else none for s in ("before", "after")}
    return pa.RecordBatch.from_arrays([pa.array(ids[start]), sides["before"], sides["after"]], ["id", "before", "after"])


def _meetings(placed: DataFrame, blocks: int) -> list[tuple[int, int]]:
    """Pairs of blocks that hold a key in common, the lower one first."""
    in_blocks = placed.select("g", F.explode("rare.key").alias("key")).distinct().groupBy("key").agg(F.collect_list("g").alias("gs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((blocks, blocks), bool)
        for batch in batches:
            lists = batch.column("gs")
            holds = np.zeros((batch.num_rows, blocks), np.float32)
            holds[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)] = 1
            seen |= holds.T @ holds > 0
        i, j = np.nonzero(np.triu(seen))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["i", "j"])

    return sorted((r.i, r.j) for r in in_blocks.select("gs").mapInArrow(run, "i int, j int").distinct().collect())


def _by_rare_keys(placed: DataFrame, blocks: int, k: int, judge: Judge) -> DataFrame:
    """(id, before, after): rows' strongest partners in one block among those that share a rare key, by all they share."""
    placed = placed.filter(F.size("rare") > 0)
    meetings = _meetings(placed, blocks)
    sent = [(u, g, kind) for u, (i, j) in enumerate(meetings) for g, kind in ([(i, _BOTH)] if i == j else [(i, _LOW), (j, _HIGH)])]
    units = placed.sparkSession.createDataFrame(sent, "unit int, g int, kind int")
    ways = placed.groupBy("g", "way").agg(F.first("common").alias("common")).select("g", F.lit(None).cast("long").alias("id"), F.lit(None).cast(HELD).alias("rare"), "way", "common")
    all_rows = placed.select("g", "id", "rare", "way", F.lit(None).cast(HELD).alias("common")).unionByName(ways)
    # the lower block knows what a key is worth
    bare = F.transform("rare", lambda h: F.struct(
        h["key"].alias("key"), F.lit(False).alias("pooled"), F.lit(0.0).alias("weight"), h["value"].alias("value"), F.lit(0).alias("signal"), F.lit(0).alias("mark")))
    dealt = all_rows.join(F.broadcast(units), "g").withColumn("rare", F.when(F.col("kind") == _HIGH, bare).otherwise(F.col("rare")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = _by_kind(batches)
        if not halves:
            return
        low = _Half(halves.pop(_BOTH) if _BOTH in halves else halves.pop(_LOW))
        high = _Half(halves.pop(_HIGH)) if halves else None
        for told in _meet(low, high or low, high is None, k, judge):
            yield _told(*told)

    return dealt.repartitionById(max(1, len(meetings)), F.col("unit")).select("kind", "id", "rare", "common", "way").mapInArrow(
        run, f"id long, before {_FOUND}, after {_FOUND}")


def _by_kind(batches: Iterator[pa.RecordBatch]) -> dict[int, list[pa.RecordBatch]]:
    found: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        for kind in np.unique(kinds):
            found.setdefault(int(kind), []).append(batch.filter(pa.array(kinds == kind)))
    return found


def _of_way(x: np.ndarray, score: np.ndarray, own: list[np.ndarray], heads: list[np.ndarray], side: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, way of the partner), best first for each row: partners of ids ``x`` on a side, where the ways score what is given."""
    out, open_, left = [], np.arange(len(x)), np.full(len(x), k)
    counted = np.flatnonzero(score > -np.inf)
    counted = counted[np.argsort(-score[counted], kind="stable")]
    for ways in np.split(counted, _starts(-score[counted])[1:]) if len(counted) else []:
        lists = [part for v in ways for part in ((own[v], heads[v]) if side == "after" else (heads[v],))]
        ids = np.concatenate(lists)
        way = np.repeat(np.repeat(ways, 2 if side == "after" else 1), [len(part) for part in lists])
        order = np.argsort(ids, kind="stable")
        ids, way = ids[order], way[order]
        here = x[open_]
        start, end = (np.searchsorted(ids, here, "right"), np.full(len(here), len(ids))) if side == "after" else (np.zeros(len(here), int), np.searchsorted(ids, here, "left"))
        many = np.minimum(end - start, left[open_])
        row = np.repeat(open_, many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        out.append((row, ids[at], way[at]))
        left[open_] -= many
        open_ = open_[left[open_] > 0]
        if not len(open_):
            break
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    row, partner, way = (np.concatenate(v) for v in zip(*out))
    order = np.argsort(row, kind="stable")
    return row[order], partner[order], way[order]


def _by_ways(placed: DataFrame, blocks: int, k: int, judge: Judge) -> DataFrame:
    """(id, before, after): each row's k strongest partners by common keys alone."""
    few = placed.filter(F.size("common") > 0)
    none = lambda kind: F.lit(None).cast(kind)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to")
    heads = few.groupBy("g", "way").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))
    ways = few.groupBy("way").agg(F.first("common").alias("common"))
    sent = few.select(F.col("g").alias("to"), F.lit(_ROW).alias("kind"), "g", "id", "way", none("array<long>").alias("ids"), none(HELD).alias("common")).unionByName(
        heads.select(everywhere, F.lit(_HEAD).alias("kind"), "g", none("long").alias("id"), "way", "ids", none(HELD).alias("common"))).unionByName(
        ways.select(everywhere, F.lit(_WAY).alias("kind"), none("int").alias("g"), none("long").alias("id"), "way", none("array<long>").alias("ids"), "common"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _by_kind(batches)
        if _ROW not in kinds:
            return
        ways, keys = _ways(kinds[_WAY])
        here = kinds[_ROW][0].column("g")[0].as_py()
        ids, way = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in kinds[_ROW]]) for c in ("id", "way"))
        way = np.searchsorted(ways, way)
        order = np.lexsort((ids, way))
        own = np.split(ids[order], np.searchsorted(way[order], np.arange(1, len(ways))))
        firsts: dict[str, list[list[np.ndarray]]] = {side: [[np.empty(0, np.int64)] for _ in ways] for side in ("before", "after")}
        for batch in kinds[_HEAD]:
            lists = batch.column("ids")
            for v, g, at in zip(np.searchsorted(ways, batch.column("way").to_numpy(zero_copy_only=False)), batch.column("g").to_numpy(zero_copy_only=False), range(batch.num_rows)):
                found = lists[at].values.to_numpy(zero_copy_only=False)
                firsts["before"][v].append(found)
                if g > here:
                    firsts["after"][v].append(found)
        heads = {side: [np.sort(np.concatenate(parts))[:k] for parts in by_way] for side, by_way in firsts.items()}
        met = _Common(keys, len(ways), keys, len(ways), judge.signals)
        every = np.arange(len(ways))
        found: dict[str, list[tuple[np.ndarray, ...]]] = {"before": [], "after": []}
        for w in np.unique(way):
            totals = met.met(np.full(len(ways), w), every)
            score = judge.score(totals)
            reason = judge.reason(totals, every)
            for side, parts in found.items():
                row, partner, other = _of_way(own[w], score, own, heads[side], side, k)
                parts.append((own[w][row], score[other], partner, reason[other]))
        for side, parts in found.items():
            all_ids, *rest = (np.concatenate(v) for v in zip(*parts))
            order = np.argsort(all_ids, kind="stable")
            if len(order):
                yield _told(side, all_ids[order], *(v[order] for v in rest))

    return sent.repartitionById(blocks, F.col("to")).drop("to").mapInArrow(run, f"id long, before {_FOUND}, after {_FOUND}")


def _explained(pairs: DataFrame, held: DataFrame, judge: Judge) -> DataFrame:
    """(x, y, score, r) of pairs (x, y) by all that ``held`` says they share."""
    mine, theirs = (held.select(F.col("id").alias(e), F.col("held").alias(f"h{e}")) for e in ("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _keys(batch.column("hx")), _keys(batch.column("hy"))
            both = np.concatenate([a.owner, b.owner])
            order = np.lexsort((np.concatenate([a.key, b.key]), both))
            key, owner = np.concatenate([a.key, b.key])[order], both[order]
            same = np.flatnonzero((key[1:] == key[:-1]) & (owner[1:] == owner[:-1]))
            which, other = order[same], order[same + 1] - len(a.key)
            runs = _starts(a.owner[which])
            if not len(runs):
                continue
            totals = _summed(a, which, _worth(a, which, b.value[other]), np.arange(len(which)), runs, judge.signals)
            score = judge.score(totals)
            kept = np.flatnonzero(score > -np.inf)
            at = pa.array(a.owner[which][runs[kept]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("x").take(at), batch.column("y").take(at), pa.array(score[kept]), pa.array(judge.reason(totals, kept), pa.int32())], ["x", "y", "score", "r"])

    return pairs.join(mine, "x").join(theirs, "y").select("x", "y", "hx", "hy").mapInArrow(run, "x long, y long, score double, r int")


def strongest_scored(rows: DataFrame, k: int, judge: Judge) -> DataFrame:
    """(x, y, score, reason), x < y: the k strongest partners of each row of (id, held) before it and after it, ties to the smaller id.

    ``rows`` is read several times, so it should be stored. A task holds two blocks of rows.
    """
    rows = rows.filter(F.size("held") > 0)
    n = rows.count()
    holders = rows.select(F.explode("held.key").alias("key")).groupBy("key").count()
    # fewer than SHARE times the keys of a row
    common = [r.key for r in holders.filter(F.col("count") > max(COMMON, n // SHARE)).collect()]
    is_common: Callable[[Column], Column] = lambda h: h["key"].isin(common) if common else F.lit(False)
    split = rows.select("id", F.filter("held", lambda h: ~is_common(h)).alias("rare"), F.sort_array(F.filter("held", is_common)).alias("common"))
    blocks = max(1, -(-n // BLOCK), min(FEW, n // LEAST))
    placed = written(split.repartitionByRange(blocks, "id").select(F.spark_partition_id().alias("g"), "id", "rare", "common", F.xxhash64("common").alias("way")))
    found = _by_rare_keys(placed, blocks, k, judge)
    many = bool(common) and placed.select("way").distinct().count() > WAYS
    if many:
        few = placed.filter(F.size("common") > 0).select("id", F.col("common").alias("held"))
        met = F.transform("held", lambda h: F.struct(*[h[f].alias(f) for f in _FIELDS[:4]])).alias("held")
        no_reason = lambda s: F.transform(s, lambda e: F.struct(e["s"].alias("s"), e["id"].alias("id"), F.lit(None).cast("int").alias("r"))).alias(s)
        more = rankjoin.strongest_lists(few.select("id", met), k).select("id", no_reason("before"), no_reason("after"))
    elif common:
        more = _by_ways(placed, blocks, k, judge)
    else:
        more = placed.limit(0).select("id", F.lit(None).cast(_FOUND).alias("before"), F.lit(None).cast(_FOUND).alias("after"))
    # by rare keys first, what common ones alone say of the same partner is too little
    lists = found.withColumn("whole", F.lit(True)).unionByName(more.withColumn("whole", F.lit(False)))
    gathered = lambda s, whole: F.flatten(F.collect_list(F.when(F.col("whole") == whole, F.col(s))))
    gathered = lists.groupBy("id").agg(*[gathered(s, w).alias(f"{s}_{w}") for s in ("before", "after") for w in (True, False)])

    def side(s: str) -> Column:
        known = F.col(f"{s}_True")
        unknown = F.filter(f"{s}_False", lambda e: ~F.array_contains(F.transform(known, lambda q: q["id"]), e["id"]))
        return F.slice(F.sort_array(F.concat(known, unknown)), 1, k).alias(s)

    found = gathered.select("id", side("before"), side("after"))
    pairs = found.select("id", F.explode(F.concat("before", "after")).alias("e")).select(
        F.least("id", "e.id").alias("x"), F.greatest("id", "e.id").alias("y"), (-F.col("e.s")).alias("score"), F.col("e.r").alias("r"))
    if not many:
        scored = pairs.distinct()
    else:
        # both ends of a pair know its rare keys, or neither does
        pairs = written(pairs)
        alone = pairs.filter("r IS NULL").select("x", "y").distinct()
        scored = pairs.filter("r IS NOT NULL").distinct().unionByName(_explained(alone, few, judge))
    return scored.select("x", "y", "score", judge.named(F.col("r")).alias("reason"))
