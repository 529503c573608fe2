"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how usual each such pair is.

Counting is external. Documents are encoded in batches; the (pair, document) records of a batch lie sorted by pair in one zstd block, and
the pairs of the batch with their numbers of documents are dealt by the first side's id into zstd runs. A task takes all runs of its ids,
merges them over a heap and counts each pair; as all pairs of one first id come together, its highest count is known when the id is
done, and what every run asked for goes back to its batch. A pair has one record for each batch, however many documents hold it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.storage import written
from tastegraph.llm.words import pieces

#: Characters and documents after which a batch is closed; a longer document is a batch of its own.
BATCH_CHARS, BATCH_DOCUMENTS = 4_000_000, 8192
#: Units a worker remembers before it starts afresh, and the longest it remembers; bounds its memory, not the texts it handles.
REMEMBERED, LONGEST = 300_000, 64
#: White space with the signs behind it. Both vocabularies end a token before a blank or line break that follows a sign that is no white
#: space: the first one's pattern starts anew there, and no piece of the second has a blank behind another sign or holds a line break.
UNIT = re.compile(r"(?:\s+\S*|\S+)(?:[^\S \n]\s*\S*)*")
BATCHES = """batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>,
    records binary, runs array<struct<radix: int, run: binary>>"""
RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as zstd; equal bytes of a column's numbers lie together."""
    head = np.array([len(columns[0]), *[c.dtype.itemsize for c in columns]], np.uint32).tobytes()
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(head + body)


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    """The columns of ``packed``."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, *widths = np.frombuffer(raw, np.uint32, columns + 1).tolist()
    out, at = [], 4 * (columns + 1)
    for w in widths:
        planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{w}").reshape(n))
        at += n * w
    return out


def _differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Units:
    """What both vocabularies make of units of text, each under a number: its sums, its groups as text, its linked pairs."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters.get(c, 63) for c in piece)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.guard = len(self.b.encode("x"))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.fits = np.empty(0, bool)
        #: n_a, n_b, n_groups, n_links of every unit
        self.sizes = np.empty((0, 4), np.int64)
        self.links = np.empty(0, np.uint32)

    def learn(self, new: list[str]) -> None:
        """Encode units and align them, all of them in one stream of bytes."""
        a = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        # the second vocabulary puts a blank before any text but an empty one; other units follow a sign whose tokens are cut off
        led = [u[0] == " " and len(u) > 1 for u in new]
        b = self.b.encode([u[1:] if ok else "x" + u for u, ok in zip(new, led, strict=True)], num_threads=1)
        b = [ids if ok else ids[self.guard:] for ids, ok in zip(b, led, strict=True)]
        whole = [u.encode("utf-8", "surrogatepass") for u in new]
        fits = np.array([b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y])
                         for x, y, w in zip(a, b, whole, strict=True)])
        if not fits.all():
            a, b, whole = ([x if ok else type(x)() for x, ok in zip(side, fits, strict=True)] for side in (a, b, whole))
        ends = np.cumsum([len(w) for w in whole])
        ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        # between two neighbouring ends of either side lies one overlap: a link
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        unit = np.searchsorted(ends, cuts)
        both = (ends_a[at_a] == cuts) & (ends_b[at_b] == cuts)
        n_groups = np.bincount(unit[both], minlength=len(new))
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        texts, i, j = [], 0, 0
        for to_a, to_b in zip((at_a[both] + 1).tolist(), (at_b[both] + 1).tolist(), strict=True):
            texts.append(",".join(text_a[i:to_a]) + "|" + ",".join(text_b[j:to_b]))
            i, j = to_a, to_b
        done = 0
        for n in n_groups.tolist():
            self.groups.append(";".join(texts[done : done + n]))
            done += n
        self.number.update(zip(new, range(len(self.fits), len(self.fits) + len(new)), strict=True))
        self.fits = np.concatenate([self.fits, fits])
        self.sizes = np.concatenate([self.sizes, np.stack(
            [np.array([len(x) for x in a]), np.array([len(x) for x in b]), n_groups, np.bincount(unit, minlength=len(new))], axis=1)])
        self.links = np.concatenate([self.links, (ids_a[at_a] << 16 | ids_b[at_b]).astype(np.uint32)])

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the numbers of the units of blank + text."""
        units = [UNIT.findall(" " + text) if text else [] for text in texts]
        known = self.number
        new = list(dict.fromkeys([u for mine in units for u in mine if u not in known]))
        if new:
            self.learn(new)
        out = [[known[u] for u in mine] for mine in units]
        for unit in new:
            if len(unit) > LONGEST:
                del known[unit]
        return out


def _byte_letters() -> dict[str, int]:
    """Bytes as byte-level BPE writes them: printable ones as themselves, the others as letters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def _of_worker(a_path: str, b_path: str) -> Units:
    """The units this worker remembers, kept from task to task."""
    return Units(a_path, b_path)


def _batch(number: int, ids: list, texts: list[str | None], units: Units, radixes: int) -> pa.RecordBatch:
    """One batch of documents as a row of ``BATCHES``."""
    told = units.numbers(texts)
    owner = np.repeat(np.arange(len(texts)), [len(mine) for mine in told])
    at = np.array([u for mine in told for u in mine], np.int64)
    unfit = np.bincount(owner, ~units.fits[at], len(texts)) > 0
    groups = ["" if bad or not mine else hashlib.sha256(";".join([units.groups[u] for u in mine]).encode()).hexdigest()
              for mine, bad in zip(told, unfit.tolist(), strict=True)]
    owner, at = owner[~unfit[owner]], at[~unfit[owner]]
    totals = [np.bincount(owner, column[at], len(texts)).astype(np.int64) for column in units.sizes.T]
    # each unit of a document once with its number there, then its links
    held, times = np.unique(owner * max(1, len(units.fits)) + at, return_counts=True)
    document, unit = np.divmod(held, max(1, len(units.fits)))
    lengths = units.sizes[:, 3]
    n, starts = lengths[unit], (np.cumsum(lengths) - lengths)[unit]
    place = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs, pair = np.unique(units.links[place], return_inverse=True)
    record, back = np.unique(pair * len(texts) + np.repeat(document, n), return_inverse=True)
    linked = np.bincount(back, np.repeat(times, n), len(record)).astype(np.uint32)
    pair, document = np.divmod(record, len(texts))
    documents = np.bincount(pair, minlength=len(pairs)).astype(np.uint32)
    radix = (pairs >> 16) % radixes
    runs = []
    for r in np.unique(radix).tolist():
        mine = radix == r
        runs.append({"radix": r, "run": packed(_differences(pairs[mine]), documents[mine])})
    records = packed(_differences(pair.astype(np.uint32)), document.astype(np.uint32), linked)
    longs, text_type = pa.list_(pa.int64()), pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([ids], longs), *[pa.array([x.tolist()], longs) for x in totals], pa.array([groups], text_type),
         pa.array([records], pa.binary()), pa.array([runs], pa.list_(pa.struct([("radix", pa.int32()), ("run", pa.binary())])))],
        ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "records", "runs"])


def encode(documents: DataFrame, a_path: str, b_path: str, radixes: int) -> DataFrame:
    """The documents in batches: their own sums, their (pair, document) records, and runs of pairs by radix of the first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, number = _of_worker(a_path, b_path), TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0
        for rows in pieces(batches):
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
                if chars >= BATCH_CHARS or len(ids) >= BATCH_DOCUMENTS:
                    yield _batch(number, ids, texts, units, radixes)
                    ids, texts, chars, number = [], [], 0, number + 1
                    if len(units.fits) > REMEMBERED:
                        units.forget()
        if ids:
            yield _batch(number, ids, texts, units, radixes)
        if len(units.fits) > REMEMBERED:
            units.forget()

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, BATCHES)


class _Run:
    """A sorted run, read one first id at a time; ``answer`` fills up in its order."""

    def __init__(self, batch: int, block: bytes) -> None:
        steps, self.documents = unpacked(block, 2)
        self.batch, self.pairs = batch, np.cumsum(steps, dtype=np.uint32)
        first = self.pairs >> 16
        self.cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        self.firsts = first[self.cuts[:-1]].tolist()
        self.answer, self.at = np.empty(len(first), np.uint64), 0


def merge(runs: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[_Run]]]:
    """For each first id in order: its pairs, their counts, whether each has the highest, and the runs that end with it.

    The heap holds one entry for each run: the first id it is at.
    """
    opened = [_Run(batch, block) for batch, block in runs]
    heap = [(run.firsts[0], k) for k, run in enumerate(opened) if run.firsts]
    heapq.heapify(heap)
    while heap:
        first, members, ended = heap[0][0], [], []
        while heap and heap[0][0] == first:
            k = heap[0][1]
            run = opened[k]
            members.append((run, slice(run.cuts[run.at], run.cuts[run.at + 1])))
            run.at += 1
            if run.at < len(run.firsts):
                heapq.heapreplace(heap, (run.firsts[run.at], k))
            else:
                heapq.heappop(heap)
                ended.append(run)
        pairs, at = np.unique(np.concatenate([run.pairs[s] for run, s in members]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([run.documents[s] for run, s in members])).astype(np.uint64)
        best = counts == counts.max()
        told, done = (counts << np.uint64(1) | best)[at], 0
        for run, s in members:
            run.answer[s] = told[done : done + s.stop - s.start]
            done += s.stop - s.start
        yield pairs, counts, best, ended


def _by_radix(batches: DataFrame, radixes: int) -> DataFrame:
    runs = batches.select("batch", F.explode("runs").alias("r")).select(F.col("r.radix").alias("radix"), "batch", F.col("r.run").alias("run"))
    return runs.repartitionById(radixes, F.col("radix")).sortWithinPartitions("radix", "batch")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(radix, its runs), one radix at a time."""
    radix, runs = None, []
    for rows in pieces(batches):
        for r, batch, run in zip(rows["radix"], rows["batch"], rows["run"], strict=True):
            if r != radix and runs:
                yield radix, runs
                runs = []
            radix = r
            runs.append((batch, run))
    if runs:
        yield radix, runs


def count_back(batches: DataFrame, radixes: int) -> DataFrame:
    """(batch, radix, answer): for each pair of a batch's run its count among all documents, and whether its first id has none higher."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for radix, runs in _groups(rows):
            for *_, ended in merge(runs):
                if ended:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([e.batch for e in ended], pa.int64()), pa.array([radix] * len(ended), pa.int32()),
                         pa.array([packed(e.answer) for e in ended], pa.binary())], ["batch", "radix", "answer"])

    return _by_radix(batches, radixes).mapInArrow(run, "batch long, radix int, answer binary")


def pair_counts(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment table: (a_id, b_id, n_documents, best) of every pair linked in any document; ``best`` marks an a_id's highest count."""
    radixes = _radixes(documents)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in _groups(rows):
            for pairs, counts, best, _ in merge(runs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pairs >> 16).astype(np.int32)), pa.array((pairs & 0xFFFF).astype(np.int32)), pa.array(counts.astype(np.int64)),
                     pa.array(best)], ["a_id", "b_id", "n_documents", "best"])

    return _by_radix(written(encode(documents, a_path, b_path, radixes)), radixes).mapInArrow(
        run, "a_id int, b_id int, n_documents long, best boolean")


def _radixes(documents: DataFrame) -> int:
    """As many radixes as the session shuffles to."""
    return int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def align_documents(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes blank + text by the byte-level vocabulary at ``a_path``, B the text by the sentencepiece model at ``b_path``, which adds
    the blank; strings of special tokens are plain text. Offsets where tokens of both end cut the bytes into groups; every A-B pair of
    token occurrences that overlap is a link. A pair of ids counts the rows that hold it linked; n_best are the links whose pair no
    other pair of their A id exceeds (ties included), count_sum adds the counts of all links.

    Texts that are NULL, empty or not given back byte by byte by both vocabularies (such as those with U+2581) have no tokens: zeros
    and an empty groups_sha256. Rows are documents: repeated rows and rows without doc_id each count and each return a row. A text of any
    length is encoded whole, as one batch if it is long. Other columns are ignored; an empty table gives none.
    """
    radixes = _radixes(documents)
    batches = written(encode(documents, a_path, b_path, radixes))
    answers = count_back(batches, radixes).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("radix", "answer"))).alias("answers"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pieces(rows, 1):
            row = {k: v[0] for k, v in row.items()}
            pair, document, linked = unpacked(row["records"], 3)
            told = [unpacked(a["answer"], 1)[0] for a in row["answers"] or []]
            n = len(row["doc_id"])
            best = total = np.zeros(n, np.int64)
            if told:
                # the answers of the radixes, each in pair order, back in the order of all pairs
                radix = np.repeat([a["radix"] for a in row["answers"]], [len(x) for x in told])
                first = np.concatenate([np.cumsum(unpacked(x["run"], 2)[0], dtype=np.uint32) for x in sorted(row["runs"], key=lambda x: x["radix"])])
                assert len(first) == len(radix)
                answer = np.concatenate(told)[np.argsort(first, kind="stable")][np.cumsum(pair)]
                counts = (answer >> np.uint64(1)).astype(np.int64)
                total = np.zeros(n, np.int64)
                np.add.at(total, document, counts * linked.astype(np.int64))
                best = np.bincount(document, linked * (answer & np.uint64(1)), n).astype(np.int64)
            columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], best.tolist(), total.tolist()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(row["groups"], pa.string())], list(RESULT))

    return batches.join(answers, "batch", "left").mapInArrow(
        run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULT))
