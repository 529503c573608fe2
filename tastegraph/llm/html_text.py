"""Main text of html pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.dom import Block, blocks
from tastegraph.llm.labelled_pages import labelled_pages
from tastegraph.llm.words import pieces

#: Steps of training, their size, how strongly weights are drawn to 0, pages a feature must be seen in.
STEPS, RATE, DECAY, LEAST_PAGES = 150, 0.1, 2e-4, 3
_WORD = re.compile(r"\S+")


def features(found: list[Block]) -> list[list[str]]:
    """Names of what holds of each block: elements and class words around it, its own element, its length, links and signs."""
    out = []
    for b in found:
        n = len(_WORD.findall(b.text))
        names = {"bias", f"own:{b.own}", f"words:{min(n, 3) if n < 4 else 10 if n < 10 else 25 if n < 25 else 99}"}
        names.update(b.around)
        names.add("links:none" if b.linked == 0 else "links:some" if b.linked < 0.6 else "links:most")
        if b.text[-1:] in ".!?":
            names.add("ends")
        if "©" in b.text[:40]:
            names.add("copyright")
        out.append(sorted(names))
    return out


@dataclass
class Field:
    """Weights of features for main text (negative: for the rest) and of steps between the two labels."""

    weights: dict[str, float]
    steps: np.ndarray  # from label, to label

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest sequence of labels, 1 for main text, by Viterbi."""
        back, (a, b) = [], (0.0, 0.0)
        (rr, rm), (mr, mm) = self.steps.tolist()
        for i, names in enumerate(features(found)):
            main = sum(self.weights.get(n, 0.0) for n in names)
            if i:
                to_rest, to_main = (a + rr >= b + mr), (a + rm > b + mm)
                back.append((0 if to_rest else 1, 0 if to_main else 1))
                a, b = max(a + rr, b + mr), max(a + rm, b + mm) + main
            else:
                b = main
        if not found:
            return []
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def expectations(node: np.ndarray, s: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By forward-backward over (page, place): each place's chance of main text, and how often each step between labels is expected in all.

    ``node`` holds the scores of both labels at every place, ``real`` is 0 beyond a page's end.
    """
    forth, back = np.zeros_like(node), np.zeros_like(node)
    both = real[:, 1:] * real[:, :-1]
    longest = node.shape[1]
    forth[:, 0] = node[:, 0]
    for t in range(1, longest):
        grown = np.logaddexp.reduce(forth[:, t - 1, :, None] + s[None], axis=1) + node[:, t]
        forth[:, t] = np.where(real[:, t, None] > 0, grown, forth[:, t - 1])
    for t in range(longest - 2, -1, -1):
        grown = np.logaddexp.reduce(s[None] + (node[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(real[:, t + 1, None] > 0, grown, 0)
    total = np.logaddexp.reduce(forth[:, -1], axis=1)
    main = np.exp(forth[:, :, 1] + back[:, :, 1] - total[:, None]) * real
    pair = forth[:, :-1, :, None] + s[None, None] + (node + back)[:, 1:, None, :] - total[:, None, None, None]
    return main, (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum(axis=(0, 1))


def train(pages: list[str], steps: int = STEPS, rate: float = RATE) -> Field:
    """Fit the field by gradient steps on the likelihood of marked pages' label sequences, all pages side by side."""
    parsed = [p for p in map(blocks, pages) if p]
    named = [features(p) for p in parsed]
    seen = Counter(n for page in named for n in {x for block in page for x in block})
    ids = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= LEAST_PAGES))}
    longest = max(map(len, parsed))
    x = np.zeros((len(parsed), longest, len(ids)))
    y = np.zeros((len(parsed), longest), np.int64)
    real = np.zeros((len(parsed), longest))
    for p, (page, names) in enumerate(zip(parsed, named, strict=True)):
        for t, (block, own) in enumerate(zip(page, names, strict=True)):
            x[p, t, [ids[n] for n in own if n in ids]] = 1
            y[p, t], real[p, t] = block.marked, 1
    w, s = np.zeros(len(ids)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    both = real[:, 1:] * real[:, :-1]
    held = np.stack([[((y[:, :-1] == i) & (y[:, 1:] == j)) * both for j in (0, 1)] for i in (0, 1)]).sum(axis=(2, 3))
    for step in range(1, steps + 1):
        node = np.stack([np.zeros_like(real), x @ w], axis=2) * real[:, :, None]
        main, expected = expectations(node, s, real)
        slopes = (np.einsum("pt,ptf->f", main - y * real, x) / len(parsed) + DECAY * w, (expected - held) / len(parsed) + DECAY * s)
        for i, (value, slope) in enumerate(zip((w, s), slopes, strict=True)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({n: float(w[i]) for n, i in ids.items()}, s)


def main_text(page: str | None, field: Field) -> str:
    """Main blocks of a page, one a line; empty if there are none."""
    found = blocks(page, field.weights)
    return "\n".join(b.text for b, label in zip(found, field.decode(found), strict=True) if label)


def extract_pages(pages: DataFrame, training: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page's main text, from its whole html.

    The field is trained on labelled pages, those of ``labelled_pages`` if none are given, before the job; its few hundred weights
    go with the tasks. NULL or empty html gives empty text, html cut off anywhere what came before. Pages of any length and depth are read
    whole, in memory that grows with the page. Repeated rows give repeated results; columns beside page_id, url and html are
    ignored, also such as are called text or n_chars. No row meets another, so nothing is shuffled.
    """
    field = train(training or labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            texts = [main_text(page, field) for page in rows["html"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["page_id"], pa.int64()), pa.array(rows["url"], pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
