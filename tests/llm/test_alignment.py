import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tastegraph.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Whole texts through both tokenizers, all pairs of tokens compared by their bytes."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    found = []
    for text in texts:
        found.append((0, 0, 0, [], ""))
        if not text:
            continue
        left, right = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        sides = []
        for ids, parts in ((left.ids, [bytes(byte[c] for c in t) for t in left.tokens]),
                           (right, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right])):
            at, side = 0, []
            for i, p in zip(ids, parts, strict=True):
                side.append((i, at, at + len(p)))
                at += len(p)
            sides.append((b"".join(parts), side))
        if any(whole != (" " + text).encode() for whole, _ in sides):
            continue
        x, y = sides[0][1], sides[1][1]
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = [",".join(str(i) for i, _, e in x if s < e <= t) + "|" + ",".join(str(i) for i, _, e in y if s < e <= t)
                  for s, t in zip([0, *ends], ends)]
        links = [(i, j) for i, s, e in x for j, u, v in y if s < v and u < e]
        found[-1] = (len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(p for *_, links, _ in found for p in set(links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    rows = [(n_a, n_b, n_g, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest)
            for n_a, n_b, n_g, links, digest in found]
    return rows, {(i, j, n, n == most[i]) for (i, j), n in counts.items()}


ODD = [None, "", " ", "\n", "  \n  x", "x\ny  z \n", "\tx\t y", "<|endoftext|> and <s> </s>", "literal ▁ sign", "a▁", "café \U0001f600\U0001f680 あい",
       "a b 　 c", "nul\x00byte", "\x1c \x1c x", "it's  we'll\r\n 12345 67", "w" * 300 + " " + "no-space" * 80, "<0x41> İstanbul ﬁ", "same words here",
       "same words here", "Same  words\there\n\n\nend   "]


def documents(spark):
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return ODD + [t[:900] for t in real if t] + [" ".join(t.split()[:9]) for t in real if t]


def result(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_equal_to_brute_force(spark, docs):
    texts = documents(spark)
    want, table = brute(texts)
    d = docs(*enumerate(texts)).repartition(3)
    got = result(alignment.align_documents(d, A, B))
    assert [got[k] for k in range(len(texts))] == want
    assert {tuple(r) for r in alignment.pair_counts(d, A, B).collect()} == table


def test_batches_and_forgetting_change_nothing(spark, docs, monkeypatch):
    texts = documents(spark)[:60]
    d = docs(*enumerate(texts)).coalesce(1)
    whole = result(alignment.align_documents(d, A, B))
    made = []
    units = alignment.Units(A, B)
    for k, text in enumerate(texts):  # one document a batch, nothing remembered
        made.append(alignment._batch(k, [k], [text], units, 3))
        units.forget()
    for name, column in (("n_a", 0), ("n_b", 1), ("n_groups", 2), ("n_links", 3)):
        assert [b.column(name)[0].as_py()[0] for b in made] == [whole[k][column] for k in range(len(texts))]
    runs = [[(k, r["run"]) for k, b in enumerate(made) for r in b.column("runs")[0].as_py() if r["radix"] == x] for x in range(3)]
    merged = {int(p): int(n) for r in runs for pairs, counts, *_ in alignment.merge(r) for p, n in zip(pairs, counts)}
    assert merged == {i << 16 | j: n for i, j, n, _ in brute(texts)[1]}


def test_repeated_rows_nameless_rows_and_ties(docs):
    got = alignment.align_documents(docs((1, "same words"), (1, "same words"), (None, "same words"), (2, None)), A, B).collect()
    rows = sorted((tuple(r)[:7] for r in got), key=repr)
    n = rows[0][4]
    assert [r[0] for r in rows] == [1, 1, 2, None] and rows[2][1:7] == (0, 0, 0, 0, 0, 0)
    assert all(r[5] == n and r[6] == 3 * n for r in rows if r[0] != 2)


def test_empty_table_and_very_long_text(docs):
    assert alignment.align_documents(docs(), A, B).count() == 0
    (row,) = alignment.align_documents(docs((7, "all work and no play " * 100_000)), A, B).collect()
    assert row["n_links"] == row["n_best"] == row["count_sum"] >= 500_000


@pytest.mark.parametrize("columns", [[np.arange(5, dtype=np.uint32)], [np.empty(0, np.uint32), np.empty(0, np.uint64)]])
def test_packed_round_trip(columns):
    back = alignment.unpacked(alignment.packed(*columns), len(columns))
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(columns, back, strict=True))
