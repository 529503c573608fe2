"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegraph.llm.storage import written
from tastegraph.llm.words import WordHash, mix, pieces, split_words

#: Samples of a fingerprint, rows of a gamma table.
SAMPLES, TABLE = 64, 1 << 16


def _gamma_table() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    p = (np.arange(TABLE) + 0.5) / TABLE
    low, high = np.zeros(TABLE), np.full(TABLE, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return high.astype(np.float32)


class Sampler:
    """Consistent weighted samples of weighted terms.

    For every term and sample, one hash gives r and c, each from a gamma distribution of shape 2, and b, uniform. With
    t = floor(ln(weight) / r + b) the term with the least ln(c) - r (t - b) - r is sampled, together with its t.
    Two documents take the same sample with the probability of their generalised Jaccard likeness, the sum of
    lesser weights over the sum of greater ones.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        self.salt = mix((np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.gamma = _gamma_table()
        self.log_gamma = np.log(self.gamma)
        self.hashes = WordHash()

    def fingerprint(self, text: str | None, block: int = 4096) -> np.ndarray:
        """16 bits for each sample of a whole text's words weighted by their count; zeros for a text without words."""
        counts = Counter(split_words(text))
        if not counts:
            return np.zeros(len(self.salt), np.uint16)
        terms = np.fromiter(map(self.hashes.__getitem__, counts), np.uint64, len(counts))
        weights = np.log(np.fromiter(counts.values(), np.float32, len(counts)))
        order = np.argsort(terms, kind="stable")  # ties of a sample don't hang on the order of words
        terms, weights = terms[order], weights[order]
        least = np.full(len(self.salt), np.inf, np.float32)
        chosen = np.zeros(len(self.salt), np.uint64)
        for at in range(0, len(terms), block):
            x, w = terms[at : at + block], weights[at : at + block]
            bits = mix(x[:, None] ^ self.salt[None, :])
            r = self.gamma[(bits & np.uint64(0xFFFF)).astype(np.intp)]
            b = ((bits >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / 65536
            t = np.floor(w[:, None] / r + b)
            cost = self.log_gamma[((bits >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)] - r * (t - b) - r
            best = cost.argmin(axis=0)
            column = np.arange(len(self.salt))
            value = cost[best, column]
            name = mix(x[best] + t[best, column].astype(np.int64).view(np.uint64))
            less = value < least
            least, chosen = np.where(less, value, least), np.where(less, name, chosen)
        return ((chosen >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The text with its last half of code points, rounded down, replaced by as many first ones of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(documents: DataFrame, samples: int = SAMPLES, slices: int | None = None) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, with their likeness and that to the next document.

    The next document is the next distinct (doc_id, text) in ascending order, NULL doc_id first, texts of one doc_id by their hash, and after
    the last the first; repeated rows give repeated results. NULL texts are empty; empty texts have a fingerprint of their own that is like no
    other. Texts of any length are read whole; other columns are ignored; an empty table gives none.

    Documents are range partitioned by (doc_id, hash of the text), into ``slices`` or as many parts as the session shuffles to, and stream through
    a part in order. The last document of each part is told apart, with the first of the next: two texts a part. So each text is
    shuffled once, a part is of the size the session asks for, and no list of bounds passes the driver.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(*([slices] if slices else []), "doc_id", "h")
    ordered = dealt.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held, waiting = None, 0  # a document and how many equal rows of it wait for the next one
        for part in pieces(batches):
            out: list[tuple] = []
            for key in zip(part["doc_id"], part["h"], part["text"], strict=True):
                if held and held[0] == key:
                    waiting += 1
                    continue
                now = (key, sampler.fingerprint(key[2]))
                if held:
                    out += [(_RESULT, *_compared(sampler, *held, *now), None, None, None)] * waiting
                else:
                    out.append((_FIRST, key[0], *[None] * 6, key[1], key[2], 1))
                held, waiting = now, 1
            yield _batch(out)
        if held:
            yield _batch([(_LAST, held[0][0], *[None] * 6, held[0][1], held[0][2], waiting)])

    told = written(ordered.mapInArrow(run, _schema(_KINDS)))
    ends = told.where(F.col("kind") != _RESULT).select("kind", "doc_id", "h", "text", "n")
    # two keys a part, without their texts
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "h", "kind")
    least = ends.agg(F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "h"))).scalar()
    after = ends.select("kind", "doc_id", "h", F.coalesce(F.lead(F.struct("doc_id", "h")).over(order), least).alias("next")).where(F.col("kind") == _LAST).select(
        F.col("doc_id").alias("last_id"), F.col("h").alias("last_h"), F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))
    firsts = ends.where(F.col("kind") == _FIRST).select(F.col("doc_id").alias("first_id"), F.col("h").alias("first_h"), F.col("text").alias("following"))
    lasts = ends.where(F.col("kind") == _LAST)
    borders = lasts.join(after, lasts.doc_id.eqNullSafe(after.last_id) & (lasts.h == after.last_h)).join(
        firsts, F.col("next_id").eqNullSafe(firsts.first_id) & (F.col("next_h") == firsts.first_h)).select("doc_id", "text", "following", "n")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for part in pieces(batches):
            out: list[tuple] = []
            for doc_id, text, following, n in zip(*[part[c] for c in ("doc_id", "text", "following", "n")], strict=True):
                pair = [((i, None, t), sampler.fingerprint(t)) for i, t in ((doc_id, text), (None, following))]
                out += [(_RESULT, *_compared(sampler, *pair[0], *pair[1]), None, None, None)] * n
            yield _batch(out)

    closed = borders.mapInArrow(close, _schema(_KINDS))
    return told.where(F.col("kind") == _RESULT).unionByName(closed).select(*_NAMES)


def _compared(sampler: Sampler, key: tuple, mark: np.ndarray, following: tuple, next_mark: np.ndarray) -> tuple:
    """A document's result, given the document that follows it."""
    doc_id, _, text = key
    edited = edit(text, following[2])
    other = sampler.fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark.tobytes().hex(), other.tobytes().hex(), likeness(mark, other), likeness(mark, next_mark)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT, _FIRST, _LAST = 0, 1, 2
#: What a part tells: results, and its first and last document with their text.
_KINDS = dict(zip(["kind", *_NAMES, "h", "text", "n"], "int long long string string string double double long string long".split(), strict=True))


def _schema(kinds: dict[str, str]) -> str:
    return ", ".join(f"{n} {k}" for n, k in kinds.items())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(_KINDS.values())], list(_KINDS))
