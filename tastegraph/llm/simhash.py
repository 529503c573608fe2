"""SimHash near-duplicates, compared 64 at a time over vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.components import components
from tastegraph.llm.spread import join_counted
from tastegraph.llm.words import pieces, split_words
from tastegraph.plans.lineage import checkpoint

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
WIDTH, HASH_SEED, RADIUS = 3, 42, 2
#: Fingerprints of a chunk; two chunks of a crowded bucket meet in one task.
CHUNK = 4096
#: Fingerprints of small buckets compared together, and (fingerprint, word of 64 lanes) pairs a step works on.
TOGETHER, PAIRS = 50_000, 1 << 18
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(words: list[bytes], width: int = WIDTH) -> int:
    """A bit is set if it is in over half the hashes of the runs of ``width`` words, repeats included; no words give 0."""
    if not words:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    text, last = b" ".join(words), min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[s : e - 1], HASH_SEED) for s, e in zip([0, *ends], ends[last:])], np.uint64)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * set_ > len(hashes)).tolist())


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, bits) of every row; bits holds the 64 bits of the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            bits = np.array([fingerprint(split_words(text), width) for text in rows["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(bits)], ["doc_id", "bits"])

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, bits long")


def bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands: fingerprints within the radius agree in one of them at least."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Planes:
    """Fingerprints of several buckets as bit planes: a bucket's members take the lanes of its own words in order."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        self.bits = bits
        self.words = -(-sizes // 64)
        self.first_word = np.cumsum(self.words) - self.words
        first = np.cumsum(sizes) - sizes
        self.bucket = np.repeat(np.arange(len(sizes)), sizes)
        self.slot = self.first_word[self.bucket] * 64 + np.arange(len(bits)) - first[self.bucket]
        lanes = np.zeros(64 * int(self.words.sum()), np.uint8)
        self.planes = np.empty((64, int(self.words.sum())), np.uint64)
        for k in range(64):
            lanes[self.slot] = (bits >> np.uint64(k)) & np.uint64(1)
            self.planes[k] = np.packbits(lanes, bitorder="little").view("<u8")
        lanes[self.slot] = 1
        self.empty = ~np.packbits(lanes, bitorder="little").view("<u8")

    def near(self, query: np.ndarray, word: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, word, lanes within the radius) of the given (query, word) pairs that have such a lane.

        Four planes at a time go through carry-save adders into counters of one bit a lane and weight. A pair is abandoned once all
        its lanes exceed the radius.
        """
        over = self.empty[word]
        ones, twos = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
        higher = [np.zeros(len(word), np.uint64) for _ in range((radius // 4).bit_length())]
        for at in range(0, 64, 4):
            d = [self.planes[k][word] ^ (np.uint64(0) - ((self.bits[query] >> np.uint64(k)) & np.uint64(1))) for k in order[at : at + 4]]
            ones, carry_a = _carry_save(ones, d[0], d[1])
            ones, carry_b = _carry_save(ones, d[2], d[3])
            twos, carry = _carry_save(twos, carry_a, carry_b)
            for k, counter in enumerate(higher):
                higher[k], carry = counter ^ carry, counter & carry
            over = over | carry | _exceeds([ones, twos, *higher], radius)
            alive = np.flatnonzero(over != FULL)
            if len(alive) < len(word):
                query, word, over, ones, twos = query[alive], word[alive], over[alive], ones[alive], twos[alive]
                higher = [counter[alive] for counter in higher]
            if not len(word):
                break
        return query, word, ~over


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in every lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, lowest weight first, is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def leaders(bits: np.ndarray, sizes: np.ndarray, radius: int, order: list[int]) -> np.ndarray:
    """For each fingerprint the place of the first one of its bucket that it reaches over links within the bucket."""
    p = Planes(bits, sizes)
    first = np.arange(len(bits))
    small = sizes <= 64
    query = np.flatnonzero(small[p.bucket])
    word = p.first_word[p.bucket[query]]
    reach = np.zeros(len(bits), np.uint64)
    for at in range(0, len(query), PAIRS):
        q, _, lanes = p.near(query[at : at + PAIRS], word[at : at + PAIRS], radius, order)
        reach[q] = lanes
    # one word a bucket: close the reach over each lane in turn
    start = np.cumsum(sizes) - sizes
    base = start[p.bucket[query]]
    for lane in range(min(64, int(sizes[small].max(initial=0)))):
        has = query[(reach[query] >> np.uint64(lane)) & np.uint64(1) == 1]
        reach[has] |= reach[start[p.bucket[has]] + lane]
    lowest = reach[query] & (~reach[query] + np.uint64(1))
    first[query] = base + np.log2(lowest.astype(np.float64)).astype(np.int64)
    for b in np.flatnonzero(~small).tolist():
        first[start[b] : start[b] + sizes[b]] = start[b] + _walk(p, b, int(start[b]), int(sizes[b]), radius, order)
    return first


def _walk(p: Planes, bucket: int, start: int, size: int, radius: int, order: list[int]) -> np.ndarray:
    """The first member that each member of a large bucket reaches: breadth first over rows of bits, each row read once."""
    words = int(p.words[bucket])
    rows = np.zeros((size, words), np.uint64)
    step = max(1, PAIRS // words)
    for at in range(0, size, step):
        n = min(step, size - at)
        query = np.repeat(np.arange(start + at, start + at + n), words)
        word = np.tile(np.arange(words) + p.first_word[bucket], n)
        q, w, lanes = p.near(query, word, radius, order)
        rows[q - start, w - p.first_word[bucket]] = lanes
    first = np.full(size, -1)
    for member in range(size):
        if first[member] >= 0:
            continue
        front = np.array([member])
        first[front] = member
        while len(front):
            seen = np.bitwise_or.reduce(rows[front], axis=0)
            met = np.flatnonzero(np.unpackbits(seen.astype("<u8").view(np.uint8), bitorder="little")[:size])
            front = met[first[met] < 0]
            first[front] = member
    return first


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that span what the fingerprints of classes (node, bits) connect at ``radius`` or fewer differing bits.

    Fingerprints within the radius agree in one of radius + 1 bands, so each is listed under its bands and compared in these buckets
    only. A crowded bucket is cut into chunks and every two chunks meet once; a bucket returns one link a fingerprint, not all pairs.
    """
    named = F.array(*[F.struct(F.lit(k).alias("band"), F.expr(f"shiftrightunsigned(bits, {a}) & {(1 << n) - 1}L").alias("key"))
                      for k, (a, n) in enumerate(bands(radius))])
    listed = checkpoint(classes.select("node", "bits", F.explode(named).alias("b")).select("node", "bits", "b.*"))
    counts = listed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    cut = join_counted(listed, counts, ["band", "key"], "n").withColumn("chunks", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}")).withColumn(
        "chunk", F.expr("pmod(xxhash64(node), chunks)"))
    others = F.expr("IF(chunks = 1, array(0L), filter(sequence(0L, chunks - 1), c -> c <> chunk))")
    dealt = cut.withColumn("with", F.explode(others)).select(
        "band", "key", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "node", "bits")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "node")
    spans = bands(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]  # node, bits, first row of each bucket
        band, last = None, None

        def found() -> pa.RecordBatch:
            nodes = np.array(held[0], np.int64)
            starts = np.array(held[2] + [len(nodes)], np.int64)
            a, n = spans[band]
            # bits of the band agree within a bucket, so they are looked at last
            order = [k for k in range(64) if not a <= k < a + n] + list(range(a, a + n))
            first = leaders(np.array(held[1], np.int64).view(np.uint64), np.diff(starts), radius, order)
            tied = np.flatnonzero(first != np.arange(len(first)))
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[first[tied]]), pa.array(nodes[tied])], ["a", "b"])

        for batch in batches:
            rows = batch.to_pydict()
            for b, key, i, j, node, bits in zip(*[rows[c] for c in ("band", "key", "i", "j", "node", "bits")], strict=True):
                if (b, key, i, j) != last:
                    if held[0] and (b != band or len(held[0]) >= TOGETHER):
                        yield found()
                    band, last = b, (b, key, i, j)
                    held[2].append(len(held[0]))
                held[0].append(node)
                held[1].append(bits)
        if held[0]:
            yield found()

    return ordered.mapInArrow(run, "a long, b long")


def near_fingerprints(documents: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per row of ``documents``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id it reaches, its own included.

    A fingerprint has a bit set if over half the XXH64 hashes (seed 42) of the runs of ``width`` lower-case words have it; a shorter
    text is one run. Fingerprints that differ in ``radius`` or fewer bits link. Texts that are NULL, empty or without words have the
    fingerprint zero, which links like any other. Equal fingerprints are one class first, so copies are never compared.

    Rows of one doc_id link all they are like. A row without doc_id has a fingerprint and no component. Repeated rows each stay.
    Texts of any length are hashed whole. Other columns are ignored; an empty table gives none.
    """
    marked = checkpoint(fingerprints(documents, width))
    classes = checkpoint(marked.groupBy("bits").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    # a doc_id with several texts ties their classes: its own class is that of its smallest bits
    several = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low <> high")
    own = marked.join(several, "doc_id").select("doc_id", "bits").distinct().join(classes, "bits").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    known = classes.where("node is not null")
    groups = components(links(known.select("node", "bits"), radius).unionByName(own), "a", "b")
    named = known.join(groups, "node", "left").select("bits", "n", F.coalesce("component", "node").alias("component_id"))
    placed = join_counted(marked.where("doc_id is not null"), named, ["bits"], "n")
    nameless = marked.where("doc_id is null").select("bits", "doc_id", F.lit(None).cast("long").alias("component_id"))
    return placed.select("bits", "doc_id", "component_id").unionByName(nameless).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
