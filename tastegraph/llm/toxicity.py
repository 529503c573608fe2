"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.words import mix, pieces, split_words

#: Bounds of the training sample: labelled documents of each class, taken in the order of a digest of their id.
TOXIC_ROWS, CLEAN_ROWS = 700, 2_100
#: Hash rows of the embedding table, its width, lengths of character n-grams, words of a window and from
#: one window to the next.
BUCKETS, WIDTH, GRAMS, WINDOW, STRIDE = 1 << 17, 8, (3, 4, 5), 16, 4
#: Standard errors that a hash row's share of toxic training documents is off for its embedding to count by half.
HALF_Z = 2.0
#: Words a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Steps of training, their size, how strongly embeddings are drawn to 0.
STEPS, RATE, DECAY = 80, 0.1, 1e-5


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows of words and of their character n-grams, ends marked, in one array by word; how many each word has."""
    marked = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    if not len(sizes):
        return np.zeros(0, np.int32), sizes
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(letters)) - starts[word]
    powers = np.cumprod(np.full(max(int(sizes.max()), *GRAMS), 0x9E3779B97F4A7C15, np.uint64))
    hashes, owners = [np.add.reduceat(letters * powers[place], starts)], [np.arange(len(sizes))]
    for n in GRAMS:
        at = np.flatnonzero(sizes[word] - place >= n)
        hashes.append(sum((letters[at + j] * powers[j] for j in range(n)), np.uint64(n)))
        owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows = (mix(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int32)
    return rows[order], np.bincount(owner, minlength=len(sizes))


@dataclass
class Model:
    """Hash rows' embeddings and the softmax over (clean, toxic)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        """What each hash row adds to the toxic logit over the clean one; a mean of embeddings has the mean of these."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each window among all words, and the document of each window.

    Windows overlap; the last one of a document ends with it and is of full length. A document of fewer words than a window's, or
    none, is one window.
    """
    n = np.asarray(counts, np.int64)
    many = 1 + np.maximum(-(-(n - WINDOW) // STRIDE), 0)
    owner = np.repeat(np.arange(len(n)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    starts = (np.cumsum(n) - n)[owner] + np.minimum(step * STRIDE, np.maximum(n - WINDOW, 0)[owner])
    return starts, starts + np.minimum(n, WINDOW)[owner], owner


def _means(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Means of the values of each window; 0 of an empty one."""
    summed = np.concatenate([[0.0], np.cumsum(values)])
    return (summed[ends] - summed[starts]) / np.maximum(ends - starts, 1)


def train(texts: list[str | None], toxic: list[int], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Fit embeddings and softmax together on labelled documents.

    A document's words are cut into windows; a window's features are the mean of its words' subword bags, and the
    document is as toxic as a soft maximum over its windows, which sharpens over the steps.
    Without both classes among the labels the model scores every text by the share of toxic labels.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-0.1, 0.1, (WIDTH, BUCKETS)) / WIDTH
    w = np.stack([-np.ones(WIDTH), np.ones(WIDTH)], axis=1) / np.sqrt(WIDTH)
    y = np.array(toxic, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros((BUCKETS, WIDTH), np.float32), w, np.array([0, -3.0 if share == 0 else 3.0]))
    bias = np.array([0, np.log(share / (1 - share))])
    ids: dict[bytes, int] = {}
    words = [np.array([ids.setdefault(x, len(ids)) for x in split_words(t)], np.int32) for t in texts]
    flat, sizes, of_word, trust = _bags(list(ids), words, y)
    stream = np.concatenate(words) if ids else np.zeros(0, np.int32)
    starts, ends, owner = _windows([len(x) for x in words])
    filled = np.maximum(ends - starts, 1)
    first = np.searchsorted(owner, np.arange(len(words)))
    params = [e, w, bias]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    for step in range(1, steps + 1):
        sharp = 1.0 + 7.0 * step / steps
        # a mean of embeddings has the mean of their margins
        rows = (w[:, 1] - w[:, 0]) @ e * trust
        vector = np.bincount(of_word, rows[flat], len(sizes)) / sizes
        margin = _means(vector[stream], starts, ends) + bias[1] - bias[0]
        top = np.maximum.reduceat(margin, first)
        power = np.exp(sharp * (margin - top[owner]))
        total = np.add.reduceat(power, first)
        said = top + np.log(total / np.bincount(owner)) / sharp
        error = (1 / (1 + np.exp(-np.clip(said, -60, 60))) - y) / len(y)
        back = error[owner] * power / total[owner]  # of a window's margin
        share_of = back / filled
        edges = np.bincount(starts, share_of, len(stream) + 1) - np.bincount(ends, share_of, len(stream) + 1)
        per_word = np.bincount(stream, np.cumsum(edges)[: len(stream)], len(sizes)) / sizes
        per_row = np.bincount(flat, per_word[of_word], BUCKETS) * trust
        pull = e @ per_row
        slopes = [(w[:, 1] - w[:, 0])[:, None] * per_row[None, :] + DECAY * e, np.stack([-pull, pull], axis=1), np.array([-back.sum(), back.sum()])]
        for value, slope, (m, v) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.05 * (slope**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-6)
    used = np.bincount(flat, minlength=BUCKETS) > 0
    return Model((e * trust * used).T, w, bias)


def _bags(names: list[bytes], words: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash rows of all words in one array, the bag size of each word, the word of each entry, how far each row is trusted.

    A row's embedding is scaled by its trust, from 0 to 1, so that drawing embeddings to 0 holds back most the rows
    whose share of toxic documents is few standard errors z off the share of all: z² / (z² + ``HALF_Z``²). No row is left out.
    """
    parts = [bags(names[i : i + 20_000]) for i in range(0, len(names), 20_000)] or [bags([])]
    flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    seen = np.zeros((2, BUCKETS))
    for x, toxic in zip(words, y, strict=True):
        if len(x):
            own = np.unique(x)
            rows = np.unique(np.concatenate([flat[at[i] : at[i + 1]] for i in own]))
            seen[int(toxic), rows] += 1
    share, n = y.mean(), np.maximum(seen.sum(0), 1)
    z = np.abs(seen[1] / n - share) / np.sqrt(share * (1 - share) / n)
    return flat, np.maximum(sizes, 1), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), z**2 / (z**2 + HALF_Z**2)


class WordScores(dict):
    """What words add to a window's logit, computed once per distinct word."""

    def __init__(self, rows: np.ndarray) -> None:
        super().__init__()
        self.rows = rows

    def learn(self, words: list[list[bytes]]) -> None:
        """Know all words of these texts; what was known before may be forgotten."""
        if len(self) >= REMEMBERED:
            self.clear()
        new = list(set().union(*words).difference(self))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            flat, sizes = bags(part)
            sums = np.bincount(np.repeat(np.arange(len(part)), sizes), self.rows[flat], len(part))
            self.update(zip(part, (sums / sizes).tolist(), strict=True))


_worker: dict[bytes, WordScores] = {}


def of_worker(rows: np.ndarray) -> WordScores:
    """The word scores this worker remembers of a model, kept from task to task; those of one model at a time."""
    name = hashlib.md5(rows.tobytes()).digest()
    if name not in _worker:
        _worker.clear()
        _worker[name] = WordScores(rows)
    return _worker[name]


def score_texts(texts: list[str | None], known: WordScores, offset: float) -> np.ndarray:
    """Toxicity of each whole text, from 0 to 1: that of its most toxic window."""
    words = [split_words(t) for t in texts]
    known.learn(words)
    counts = [len(x) for x in words]
    values = np.fromiter((v for x in words for v in map(known.__getitem__, x)), np.float64, sum(counts))
    starts, ends, owner = _windows(counts)
    margin = _means(values, starts, ends) + offset
    first = np.searchsorted(owner, np.arange(len(words)))
    return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(margin, first), -60, 60))) if len(words) else np.empty(0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees: crc32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``toxic_rows`` and ``clean_rows`` labelled documents outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    of = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = of(1, toxic_rows).union(of(0, clean_rows))  # a bounded sample
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """The model of a bounded sample of labelled documents; only that sample comes to the driver."""
    rows = sorted(((r["doc_id"], r["text"] or "", r["toxic"]) for r in training_sample(documents, labels, toxic_rows, clean_rows).toLocalIterator()))
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(documents: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """Documents with all their columns and a score of their whole text under ``name``, in place of a column of that name.

    NULL and empty texts get the score of no words.
    """
    rows, offset = model.rows(), model.offset()
    given = documents.drop(name).withColumn("__text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_worker(rows)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1)], ["t"])
            said = [score_texts(part["t"], known, offset) for part in pieces(iter([texts]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(said or [np.empty(0)]))], [*batch.schema.names[:-1], name])

    return given.mapInArrow(run, documents.drop(name).schema.add(name, "double"))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted.

    Training uses labels outside the held-out part only; lang, source, doc_id and labels are no inputs of a score. Labels without
    a document, NULL labels and labels other than 0 and 1 are passed over. Repeated rows get equal scores.
    """
    model = fit(documents, labels)
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all columns, that score below the threshold."""
    return score(documents, fit(documents, labels), "__toxic").where(F.col("__toxic") < threshold).drop("__toxic")
