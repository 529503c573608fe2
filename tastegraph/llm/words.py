"""Words and hashes for the Python side of the operators: small helpers used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Entries a per-task word cache may hold before it starts afresh; bounds a task's memory, not the words it handles.
CACHE = 1_000_000
#: Rows of an Arrow batch turned into Python objects at once.
ROWS = 128


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[dict[str, list]]:
    """The batches as column lists of a few rows each, so that very long texts are held a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


class WordHash(dict):
    """64-bit hashes of words, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], hashes: WordHash, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; a shorter text is one run, no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    w = min(width, len(h))
    out = np.full(n, w, np.uint64)
    for i in range(w):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)
