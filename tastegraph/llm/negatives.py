"""Hard negatives of anchor vectors by a vertical scan of columnar blocks (BOND)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegraph.plans.lineage import checkpoint

#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 5, 80, 100
#: Vectors of a block, dimensions read between two looks at the candidates.
BLOCK, DIMENSIONS = 4096, 8
#: Anchors of a group, which meets every stripe of the vectors; stripes bound what one task reads and what it returns.
GROUP, STRIPES = 4096, 32
LONG = 2**63 - 1


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, with labels and components as the scan reads them."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x * 256.0))
    rows = e.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    one = rows.select("vec_id", F.struct(label.alias("label"), whole.alias("q")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", "v.label", "v.q")


class Anchors:
    """The anchors a task holds, as integer vectors with each one's order of dimensions."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.labels: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.orders: list[np.ndarray] = []
        self.windows: list[list[int]] = []
        self.found: list[list] = []

    def add(self, vec_id: int, label: int, q: list[int], windows: list[int]) -> None:
        a = np.array(q, np.int64)
        self.ids.append(vec_id)
        self.labels.append(label)
        self.vectors.append(a)
        self.orders.append(np.argsort(-np.abs(a.astype(np.float64)), kind="stable"))
        self.windows.append(windows)
        self.found.append([[] for _ in windows])


class Block:
    """Vectors of one length, a row of ``columns`` for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        self.ids, self.labels, self.columns = ids, labels, np.ascontiguousarray(q.T)
        self.least, self.most = (f(self.columns, axis=1).astype(np.float64) for f in (np.min, np.max))
        self.largest = max(1, *(int(x) for x in np.abs(np.concatenate([[0.0], self.least, self.most]))))
        self.low, self.high = int(labels.min()), int(labels.max())
        self.exact: dict[type, np.ndarray] = {}

    def as_(self, kind: type) -> np.ndarray:
        if kind not in self.exact:
            self.exact[kind] = self.columns.astype(kind)
        return self.exact[kind]


def scan(block: Block, a: np.ndarray, order: np.ndarray, candidates: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates whose score ``keep`` cannot rule out, scores exact.

    Dimensions are read in ``order``. What is left to read adds between a least and a most to any score, by the block's extremes;
    ``keep(lower, upper)`` says which bounds may still belong to a result. A dropped candidate is never read again.
    """
    bound = int(np.abs(a.astype(np.float64)).max(initial=0)) * block.largest * max(1, len(a))
    if bound >= 2**52:
        # beyond exact floats: whole numbers of Python, held to the range of a long
        at = np.flatnonzero(candidates)
        scores = block.columns[:, at].astype(object).T @ a.astype(object) if len(a) else [0] * len(at)
        exact = np.array([min(max(int(s), -LONG - 1), LONG) for s in scores], np.int64)
        return at, exact
    kind = np.float32 if bound < 2**23 else np.float64
    columns, w = block.as_(kind), a.astype(kind)
    ends = np.stack([a * block.least, a * block.most])[:, order]
    rest_low, rest_high = (np.append(np.cumsum(x[::-1])[::-1], 0.0) for x in (ends.min(axis=0), ends.max(axis=0)))
    at, score = None, np.zeros(len(block.ids), kind)
    alive = candidates & keep(score + rest_low[0], score + rest_high[0])
    for k in range(0, len(a), DIMENSIONS):
        n = np.count_nonzero(alive)
        if n == 0:
            break
        if n < len(alive) // 2:
            held = np.flatnonzero(alive)
            at = held if at is None else at[held]
            score, alive = score[held], np.ones(n, bool)
        d = order[k : k + DIMENSIONS]
        score = score + w[d] @ (columns[d] if at is None else columns[d[:, None], at])
        done = min(k + DIMENSIONS, len(a))
        alive &= keep(score + rest_low[done], score + rest_high[done])
    held = np.flatnonzero(alive)
    return held if at is None else at[held], score[held].astype(np.int64)


def _best(found: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k first of (-score, id) with new ones added."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
        first = np.lexsort((ids, -scores.astype(np.float64)))[:k] if abs(int(least)) < 2**52 else range(len(ids))
        ids, scores = ids[first], scores[first]
    return sorted(found + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)])[:k]


def _positives(anchors: Anchors, k: int, block: Block, at: int, n: int) -> None:
    if not block.low <= anchors.labels[at] <= block.high:
        return
    found = anchors.found[at][0]
    known = -found[-1][0] if len(found) == n else -np.inf

    same = block.labels == anchors.labels[at]
    same &= block.ids != anchors.ids[at]

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= known

    places, scores = scan(block, anchors.vectors[at], anchors.orders[at], same, keep)
    anchors.found[at][0] = _best(found, block.ids[places], scores, n)


def _negatives(anchors: Anchors, k: int, block: Block, at: int, n: int) -> None:
    if block.low == block.high == anchors.labels[at]:
        return
    spans = []
    for found, positive in zip(anchors.found[at], anchors.windows[at], strict=True):
        least, most = -(-LEAST * positive // 100), MOST * positive // 100
        spans.append((max(least, -found[-1][0]) if len(found) == n else least, most))

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        within = np.zeros(len(lower), bool)
        for least, most in spans:
            within |= (upper >= least) & (lower <= most)
        return within

    places, scores = scan(block, anchors.vectors[at], anchors.orders[at], block.labels != anchors.labels[at], keep)
    for w, (least, most) in enumerate(spans):
        inside = (scores >= least) & (scores <= most)
        anchors.found[at][w] = _best(anchors.found[at][w], block.ids[places[inside]], scores[inside], n)


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, look: Callable, n: int) -> DataFrame:
    """(anchor_id, positive_score, other_id, score): the n first a stripe holds for every window of every anchor (vec_id, label, q, windows)."""
    unit = lambda group, stripe: (group * STRIPES + stripe).cast("int").alias("unit")
    group, stripe = F.pmod(F.xxhash64("vec_id"), F.lit(groups)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(STRIPES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = anchors.withColumns({"__group": group, "__stripe": every(STRIPES)}).select(
        unit(F.col("__group"), F.col("__stripe")), F.lit(0).alias("kind"), "vec_id", "label", "q", "windows")
    read = rows.withColumns({"__stripe": stripe, "__group": every(groups)}).select(
        unit(F.col("__group"), F.col("__stripe")), F.lit(1).alias("kind"), "vec_id", "label", "q", F.lit(None).cast("array<bigint>").alias("windows"))
    both = dealt.unionByName(read).withColumn("dimensions", F.size("q"))
    # a group's anchors come first, then its vectors by length and label
    ordered = both.repartitionById(groups * STRIPES, F.col("unit")).sortWithinPartitions("unit", "kind", "dimensions", "label", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = Anchors(), None

        def told() -> pa.RecordBatch:
            out = [(a, w, i, -s) for a, windows, found in zip(held.ids, held.windows, held.found, strict=True)
                   for w, best in zip(windows, found, strict=True) for s, i in best]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], ["anchor_id", "positive_score", "other_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for part in _runs(batch.slice(at, BLOCK)):
                    here, kind, dimensions, size = *[part.column(c)[0].as_py() for c in ("unit", "kind", "dimensions")], part.num_rows
                    if here != unit:
                        if held.ids:
                            yield told()
                        held, unit = Anchors(), here
                    ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                    if kind == 0:
                        for row in zip(*[part.column(c).to_pylist() for c in ("vec_id", "label", "q", "windows")], strict=True):
                            held.add(*row)
                        continue
                    q = part.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(size, dimensions)
                    block = Block(ids, labels, q)
                    for a in range(len(held.ids)):
                        if len(held.vectors[a]) == dimensions:
                            look(held, a, block, a, n)
        if held.ids:
            yield told()

    return ordered.mapInArrow(run, "anchor_id long, positive_score long, other_id long, score long")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where unit, kind or length of vectors change."""
    marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "kind", "dimensions")])
    cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n first of each key with their rank, of at most n rows a stripe."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every positive of every anchor.

    Rows with a NULL vec_id, label or vector, or with a NULL or non-finite component, take no part; rows of one vec_id count as one,
    that of the smallest label, then vector. Labels of a vec_id divisible by 7 become (label + 1) % 10; components become floor(256 * x),
    held to the range of a long. A score is the inner product, also held to it; vectors of different lengths have none and are no partners.
    Higher scores come first, ties by smaller vec_id, so copies of a vector follow each other by vec_id.

    Every anchor (``is_anchor`` over vec_id, label, q) is a stated query against all rows, in blocks: groups of anchors meet stripes of rows,
    and a task holds one group and one block. An anchor without rows of its label or in the window returns none, as does an empty table.
    Other columns are ignored.
    """
    rows = checkpoint(vectors(embeddings))
    anchors = rows.where(is_anchor)
    groups = -(-anchors.count() // GROUP)
    if groups == 0:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = _searched(rows, anchors.withColumn("windows", F.array(F.lit(0).cast("long"))), groups, _positives, positives)
    best = checkpoint(_first(found.select("anchor_id", "other_id", "score"), ["anchor_id"], positives).select(
        "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # positives of one score share a window
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    against = _searched(rows, anchors.join(windows, "vec_id"), groups, _negatives, negatives)
    ranked = _first(against, ["anchor_id", "positive_score"], negatives)
    return best.join(ranked, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """``mine`` for the anchors whose vec_id is divisible by ``every``."""
    return mine(embeddings, F.col("vec_id") % every == 0)


#: DuckDB SQL for the rows of ``hard_negatives`` over ``embeddings`` with one row a vec_id.
SQL = """
WITH valid AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score
WINDOW nearest AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER nearest <= 5"""
