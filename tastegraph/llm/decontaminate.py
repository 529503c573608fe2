"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max pruning."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.spread import join_counted
from tastegraph.llm.storage import written
from tastegraph.llm.words import CACHE, pieces, split_words
from tastegraph.plans.lineage import checkpoint

#: Words of a passage and of the step to the next, share of an item's own score that retrieves it, words of a compared
#: run, share of the runs of question and of answer that a leak must hold.
PASSAGE, STEP, RETRIEVED, RUN, HELD = 64, 32, 0.5, 5, 0.6
#: Words up to which one changed word can take a half below ``HELD`` of its runs; words that may be added or missing where a half is looked for.
SHORT, SLACK = 16, 2
#: BM25's two parameters.
K1, B = 1.2, 0.75
#: Words an item needs to have two halves; a shorter one says too little to tell a leak.
LEAST_WORDS = 3
#: Parts of items in an index block, terms whose block impacts are kept as a dense table, passages scored at once;
#: characters of items in one index. More items are searched for in several indexes, one after another.
BLOCK, DENSE, ROWS, INDEX_CHARS = 4, 256, 1024, 2_000_000
#: Digits of a score; the order in which an index adds impacts changes those behind.
DIGITS = 9

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def _term(word: bytes) -> bytes:
    """A word without what is neither letter nor digit at its ends."""
    if word.isalnum():
        return word
    return _EDGES.sub("", word.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")


def terms_of(text: str | None) -> list[bytes]:
    """Words in lower case without signs around them; signs alone are no words."""
    return [t for w in split_words(text) if (t := _term(w))]


def halves(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence is the answer; of a single sentence it is the last third of the words."""
    parts = [p for p in _SENTENCE.split(text or "") if terms_of(p)]
    if len(parts) > 1:
        return [t for p in parts[:-1] for t in terms_of(p)], terms_of(parts[-1])
    words = terms_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def _runs(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(RUN, len(ids))
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if n else set()


@dataclass
class Corpus:
    """What BM25 needs of all items: their parts, the words of these, and in how many parts a term stands."""

    parts: int
    words: int
    df: Mapping[bytes, int]


@dataclass
class Index:
    """BM25 impacts of items' terms as shares of the score that retrieves the item, in blocks of items with their largest impact.

    Terms are numbered by falling number of blocks that hold them: the first ones have their block impacts in ``dense``,
    the others are posted as (block, largest impact there).
    """

    term_ids: dict[bytes, int]
    item_ids: list[int]
    question: list[set]
    answer: list[set]
    sides: list[list[list[int]]]  # words of question and of answer
    lengths: list[int]
    top: np.ndarray  # largest impact of a term on any item; the last entry, 0, is of words outside the index
    dense: np.ndarray  # (term, block)
    posted: np.ndarray  # where a term's postings start
    blocks: np.ndarray
    block_top: np.ndarray
    impacts: list[dict[int, np.ndarray]]  # of each block, by term
    owners: list[list[int]]  # items of each block


def _parts(words: list[bytes]) -> list[list[bytes]]:
    """Even parts of at most a step, so that a passage holds each part whole wherever it lies."""
    n = -(-len(words) // STEP)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def build(items: list[tuple[int, str | None]], retrieved: float = RETRIEVED, corpus: Corpus | None = None) -> Index:
    """Index items by their words, weighted over the ``corpus`` of all items, these alone if none is given.

    Items of fewer than ``LEAST_WORDS`` words are never found.
    """
    known = [(item_id, text, words) for item_id, text in items if len(words := terms_of(text)) >= LEAST_WORDS]
    entries = [(i, Counter(part)) for i, (_, _, words) in enumerate(known) for part in _parts(words)]
    if corpus is None:
        corpus = Corpus(len(entries), sum(sum(c.values()) for _, c in entries), Counter(t for _, c in entries for t in c))
    df, n, average = corpus.df, corpus.parts, corpus.words / max(corpus.parts, 1)
    weighed = []
    for item, c in entries:
        norm = K1 * (1 - B + B * sum(c.values()) / average)
        impact = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
        least = retrieved * sum(impact.values())
        weighed.append((item, {t: v / least for t, v in impact.items()}))
    # neighbours in a block share their rarest words as far as possible
    weighed.sort(key=lambda w: (sorted(w[1], key=lambda t: (df[t], t))[:2], w[0]))
    groups = [weighed[b : b + BLOCK] for b in range(0, len(weighed), BLOCK)]
    tops: dict[bytes, dict[int, float]] = {}
    for b, group in enumerate(groups):
        for _, impact in group:
            for t, v in impact.items():
                own = tops.setdefault(t, {})
                own[b] = max(v, own.get(b, 0.0))
    ids = {t: i for i, t in enumerate(sorted(tops, key=lambda t: (-len(tops[t]), t)))}
    names = list(ids)
    dense = np.zeros((min(DENSE, len(ids)), max(len(groups), 1)), np.float32)
    for t in names[:DENSE]:
        for b, v in tops[t].items():
            dense[ids[t], b] = v
    listed = [sorted(tops[t].items()) if i >= DENSE else [] for i, t in enumerate(names)]
    impacts: list[dict[int, np.ndarray]] = []
    for group in groups:
        rows: dict[int, np.ndarray] = {}
        for k, (_, impact) in enumerate(group):
            for t, v in impact.items():
                rows.setdefault(ids[t], np.zeros(BLOCK))[k] = v
        impacts.append(rows)
    words = [[[ids[t] for t in part] for part in halves(text)] for _, text, _ in known]
    sides = [[_runs(part) for part in pair] for pair in words]
    return Index(
        ids, [i for i, _, _ in known], [q for q, _ in sides], [a for _, a in sides], words, [len(w) for _, _, w in known],
        np.array([max(tops[t].values()) for t in names] + [0.0]), dense, np.cumsum([0] + [len(x) for x in listed]),
        np.array([b for x in listed for b, _ in x], np.int64), np.array([v for x in listed for _, v in x], np.float64), impacts,
        [[item for item, _ in group] for group in groups])


class TermIds(dict):
    """Number of a raw word's term in the index, -1 outside it, -2 for signs alone."""

    def __init__(self, index: Index) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE // 2:
            self.clear()
        term = _term(word)
        value = self[word] = self.index.term_ids.get(term, -1) if term else -2
        return value


def passages(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts' term numbers, -1 beyond a text's end: (text, first word, rows of terms)."""
    owner, first, rows = [], [], []
    for i, ids in enumerate(texts):
        at = np.arange(0, max(len(ids) - STEP, 1), STEP)
        padded = np.concatenate([ids, np.full(PASSAGE, -1, np.int64)])
        rows.append(padded[at[:, None] + np.arange(PASSAGE)[None, :]])
        owner.append(np.full(len(at), i))
        first.append(at)
    return np.concatenate(owner), np.concatenate(first), np.concatenate(rows)


def retrieve(grid: np.ndarray, index: Index) -> list[tuple[int, int, float]]:
    """(row, item, score) of every passage and every item whose score reaches the retrieving one, 1.0.

    The largest impacts of its terms bound a passage, then their largest impacts in a block bound the block; only blocks whose
    bound reaches the threshold are scored item by item, so all items above it are found.
    """
    alive = np.flatnonzero(index.top[grid].sum(axis=1) >= 1)  # repeated words only loosen the bound
    found: list[tuple[int, int, float]] = []
    for at in range(0, len(alive), ROWS):
        own = alive[at : at + ROWS]
        terms = np.sort(grid[own], axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1
        row, column = np.nonzero((terms >= 0) & (terms < len(index.dense)))
        there = np.zeros((len(own), len(index.dense)), np.float32)
        there[row, terms[row, column]] = 1
        bound = there @ index.dense
        row, column = np.nonzero(terms >= len(index.dense))
        rare = terms[row, column]
        many = index.posted[rare + 1] - index.posted[rare]
        post = np.repeat(index.posted[rare] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = np.repeat(row, many) * bound.shape[1] + index.blocks[post]
        bound += np.bincount(cells, index.block_top[post], bound.size).reshape(bound.shape)
        for p, b in zip(*np.nonzero(bound >= 1 - 1e-5), strict=True):
            rows, scores = index.impacts[b], np.zeros(BLOCK)
            for t in terms[p].tolist():
                if t in rows:
                    scores += rows[t]
            found += [(int(own[p]), index.owners[b][k], float(scores[k])) for k in np.flatnonzero(scores >= 1 - 10.0**-DIGITS)]
    return found


def leaks(texts: list[str | None], index: Index, known: TermIds) -> list[list[tuple[int, int, float, float, float]]]:
    """Per text (item_id, first word of the passage, score, question and answer overlap) of the items it holds, by its best passage."""
    numbered = []
    for text in texts:
        words = split_words(text)
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        numbered.append(ids[ids > -2])
    best: list[dict[int, tuple]] = [{} for _ in texts]
    if not texts:
        return []
    owner, first, grid = passages(numbered)
    for p, item, score in sorted(set(retrieve(grid, index))):
        ids, at, held = numbered[owner[p]], int(first[p]), best[owner[p]]
        reach = index.lengths[item]
        words = ids[max(0, at - reach) : at + PASSAGE + reach].tolist()
        near = _runs_of(words, index, item)
        q, a = (len(near & part) / len(part) for part in (index.question[item], index.answer[item]))
        question, answer = index.sides[item]
        # a short half may have lost all its runs by one word; it is looked for beside the other half
        if q >= HELD > a and len(answer) <= SHORT:
            a = max(a, _beside(words, question, answer))
        elif a >= HELD > q and len(question) <= SHORT:
            q = max(q, _beside(words[::-1], answer[::-1], question[::-1]))
        if q >= HELD and a >= HELD and (item not in held or (q + a, round(score, DIGITS)) > (held[item][3] + held[item][4], held[item][2])):
            held[item] = (index.item_ids[item], at, round(score, DIGITS), q, a)
    return [sorted(h.values(), key=lambda x: (x[0] is None, x[0] or 0)) for h in best]


def _runs_of(ids: list[int], index: Index, item: int) -> set:
    """Runs of the lengths that question and answer have; both are shorter than a run only in very short items."""
    sizes = {len(next(iter(part))) for part in (index.question[item], index.answer[item])}
    return {tuple(ids[i : i + n]) for n in sizes for i in range(len(ids) - n + 1)}


def _beside(words: list[int], held: list[int], short: list[int]) -> float:
    """Share of the words of ``short`` that follow ``held`` in their order, wherever runs of ``held`` say that it ends."""
    n = min(RUN, len(held))
    at: dict[tuple[int, ...], int] = {tuple(held[i : i + n]): i for i in range(len(held) - n + 1)}
    ends: dict[int, int] = {}  # where held ends, by where a run that says so ends
    for p in range(len(words) - n + 1):
        i = at.get(tuple(words[p : p + n]))
        if i is not None:
            ends[p + len(held) - i] = p + n
    return max((_in_order(short, words[max(e - SLACK, run) : e + len(short) + SLACK]) for e, run in ends.items()), default=0) / len(short)


def _in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _weighed(items: DataFrame) -> tuple[DataFrame, int, int]:
    """(item_id, text, terms): the items with how many parts of all items hold each of their terms; number of parts and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            out = [(item_id, text, k, len(part), sorted(set(part))) for item_id, text in zip(rows["item_id"], rows["text"], strict=True)
                   if len(words := terms_of(text)) >= LEAST_WORDS for k, part in enumerate(_parts(words))]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["item_id", "text", "part", "words", "terms"])

    parts = checkpoint(items.mapInArrow(run, "item_id long, text string, part int, words long, terms array<binary>"))
    n, words = parts.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    listed = checkpoint(parts.select("item_id", "text", F.explode("terms").alias("term")))
    df = listed.groupBy("term").agg(F.count("*").alias("n"))
    terms = join_counted(listed, df, ["term"], "n").select("item_id", "text", F.struct("term", "n").alias("t")).groupBy("item_id", "text").agg(
        F.collect_set("t").alias("terms"))
    return terms, n, words


def find_leaks(documents: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, score, question_overlap, answer_overlap): every item that a document's whole text holds.

    An item's passages are retrieved by BM25 from every window of a text's words, all of them above the threshold, and count
    if runs of words of both its question and its answer are there; a short half whose runs are broken counts by the share of its
    words that stand in order beside the other half. BM25's statistics are of all items, so how many indexes there are changes no row. An
    index holds about ``index_chars`` characters of items: one at a time passes the driver, and the documents are read once for each.

    Rows with NULL or empty texts, in either table, and items of fewer than ``LEAST_WORDS`` words leak nothing. Repeated documents give
    repeated results, a repeated item counts once, of equal passages the first is told. Texts of any length are read whole. Columns beside
    doc_id, item_id and text are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    terms, parts, words = _weighed(items)
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // index_chars) or 1
    terms = written(terms.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in range(blocks):
        rows = sorted(((r["item_id"], r["text"], r["terms"]) for r in terms.where(F.col("block") == block).collect()),  # bounded by index_chars
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        df = {bytes(t["term"]): t["n"] for *_, held in rows for t in held}
        part = texts.mapInArrow(_search([r[:2] for r in rows], Corpus(parts, words, df)), _RESULT)
        # all but the last are written at once, so the driver holds the items of one index
        part = part if block == blocks - 1 else written(part)
        found = part if found is None else found.union(part)
    return found


_RESULT = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"


def _search(rows: list[tuple[int, str]], corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build(rows, corpus=corpus)
        known = TermIds(index)
        for part in pieces(batches):
            found = leaks(part["text"], index, known)
            out = [(doc_id, *leak) for doc_id, held in zip(part["doc_id"], found, strict=True) for leak in held]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _RESULT.split(", ")])

    return run


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, that hold no benchmark item."""
    held = find_leaks(documents, benchmark).select(F.col("doc_id").alias("__held")).where("__held is not null").distinct()
    return documents.join(held, documents["doc_id"].cast("long") == F.col("__held"), "left_anti")
