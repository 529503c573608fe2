"""Packing documents into sequences as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegraph.llm.tokens import of_worker
from tastegraph.llm.words import pieces
from tastegraph.plans.lineage import checkpoint
from tastegraph.plans.slices import with_rank

#: Tokens of a sequence, id that ends a document, tokens of a length class, slices of a class's ranking.
CAPACITY, END_ID, UNIT, SLICES = 2048, 1, 8, 256
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and ``end_id``, cut into full pieces and one rest: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = of_worker(tokenizer_path), struct.pack("<I", end_id)
        for rows in pieces(batches):
            out: list[tuple] = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = tokens.ids(text) + last
                n = len(ids) // 4
                out += [(doc_id, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def _price(values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how often each size 1..capacity is in the most valuable fill."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gains = best[c - 1 :: -1][:c] + values[:c]  # size s leaves c - s
        s = int(np.argmax(gains))
        best[c], took[c] = (gains[s], s + 1) if gains[s] > best[c - 1] else (best[c - 1], 0)
    fill, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if took[c]:
            fill[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return fill


def solve(demand: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand[s - 1]`` pieces of size s in bins of ``len(demand)``.

    A revised simplex holds the master programme (least bins that cover the demand); each round the knapsack prices a new
    column and it enters if a bin's worth at the duals is over one. The optimum is rounded down, and what
    that leaves over, less than a bin a pattern, is placed by decreasing first fit.
    """
    capacity, sizes = len(demand), np.flatnonzero(demand)
    if not len(sizes):
        return []
    m, d = len(sizes), demand[sizes].astype(float)
    columns = np.zeros((m, m))
    columns[np.arange(m), np.arange(m)] = capacity // (sizes + 1)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ d
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # every bin costs one
        values = np.full(capacity, -1.0)
        values[sizes] = duals
        fill = _price(values, capacity)
        column = fill[sizes].astype(float)
        if duals @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        amount = np.maximum(amount - ratio[leave] * step, 0)
        amount[leave] = ratio[leave]
        columns[:, leave] = column
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= step[others, None] * inverse[leave]
    used, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-amount, kind="stable"):
        fill = np.zeros(capacity, np.int64)
        fill[sizes] = np.rint(columns[:, j]).astype(np.int64)
        if not fill.any():
            continue
        times = min(int(np.floor(amount[j] + 1e-6)), int((left[fill > 0] // fill[fill > 0]).min()))
        if times > 0:
            used.append((fill, times))
            left -= times * fill
    return used + _first_fit(left)


def _first_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Bins for the pieces left over, largest first into the fullest bin that still takes them; equal bins count together."""
    capacity = len(left)
    room: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    for s in range(capacity, 0, -1):
        for _ in range(int(left[s - 1])):
            free = next((f for f in range(s, capacity + 1) if room[f]), 0)
            fill = room[free].pop() if free else np.zeros(capacity, np.int64)
            fill[s - 1] += 1
            room[(free or capacity) - s].append(fill)
    counted: dict[bytes, list] = {}
    for fill in (f for group in room for f in group):
        counted.setdefault(fill.tobytes(), [fill, 0])[1] += 1
    return [(fill, times) for fill, times in counted.values()]


def places(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, first rank, end rank, per bin, first sequence, slot): which ranks of a size go to which run of sequences."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for fill, times in patterns:
        slot = 0
        for s in reversed(np.flatnonzero(fill)):
            k, size = int(fill[s]), int(s) + 1
            first = given.get(size, 0)
            out.append((size, first, first + k * times, k, sequence, slot))
            given[size] = first + k * times
            slot += k
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, slices: int = SLICES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, start, length, ...) of at most ``capacity`` tokens.

    The driver sees a histogram of ``capacity / unit`` lengths only, whatever the number of pieces; its patterns say
    which ranks of a length share a sequence. Pieces of a length are ranked by document in slices, so that a frequent length is
    spread over all tasks. Repeated rows are pieces of their own; an empty table packs into nothing.
    """
    spark = cut.sparkSession
    size = F.ceil(F.col("length") / unit).cast("int")
    sized = cut.withColumn("__size", size)
    demand = np.zeros(capacity // unit, np.int64)
    for row in sized.groupBy("__size").count().collect():  # at most capacity / unit rows
        demand[row["__size"] - 1] = row["count"]
    plan = spark.createDataFrame(
        places(solve(demand)), "__size int, __first long, __end long, __each int, __sequence long, __slot int")
    # most runs of ranks belong to few sizes: a piece looks its run up among those of its size
    runs = plan.groupBy("__size").agg(F.sort_array(F.collect_list(F.struct("__first", "__end", "__each", "__sequence", "__slot"))).alias("__runs"))
    ranked = with_rank(
        sized, ["__size"], F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)),
        [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "__rank").withColumn("__rank", F.col("__rank") - 1)
    placed = ranked.join(F.broadcast(runs), "__size").withColumn(  # at most one row for each length class
        "__run", F.expr("filter(__runs, r -> r.__first <= __rank and __rank < r.__end)[0]"))
    inside = F.col("__rank") - F.col("__run.__first")
    placed = placed.withColumns({
        "sequence_id": F.col("__run.__sequence") + F.expr("(__rank - __run.__first) div __run.__each"),
        "__slot": F.col("__run.__slot") + F.pmod(inside, F.col("__run.__each")),
    })
    # a sequence holds at most ``capacity`` pieces
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop(
        "__size", "__rank", "__runs", "__run", "__slot")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """Tokens of all documents in sequences of ``capacity``: one row per piece.

    A NULL or empty text is its end id alone. Sequences are to be padded to ``capacity``. Only ids of
    documents, lengths and checksums travel between tasks; the pieces are written once, so texts are read once.
    """
    return pack(checkpoint(cut_documents(documents, tokenizer_path, capacity, end_id)), capacity, unit)
