import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tastegraph.llm.packing import pack_documents, places, solve
from tastegraph.llm.tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n", "It's IT'S 'S", "a<|endoftext|>b", "naïve ÀÉß über", "İI ẞ Σσς", "１２3 ٣", "a\x1cb \x1d", "é é ́x", "漢字 かな 😀😀!?", "x.,;:!? '", "\x00\x01", "don't.we'll"]


def test_ids_equal_the_tokenizers():
    tokens, plain = WordTokens(PATH), Tokenizer.from_file(PATH)
    for text in [*ODD, " ".join(ODD), " ".join(ODD)]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert tokens.ids(text) == struct.pack(f"<{len(ids)}I", *ids), text
    assert tokens.ids(None) == b""


@pytest.mark.parametrize("demand", [[0] * 32, [0] * 31 + [5], [7] * 32, [1000 if i % 5 == 2 else 3 for i in range(32)], [50_000] + [0] * 31])
def test_patterns_cover_the_demand(demand):
    demand = np.array(demand)
    patterns = solve(demand)
    made = sum((fill * times for fill, times in patterns), np.zeros(32, int))
    assert (made == demand).all()
    sizes = np.arange(1, 33)
    assert all(fill @ sizes <= 32 for fill, _ in patterns)
    bins, least = sum(t for _, t in patterns), -(-int(demand @ sizes) // 32)
    assert bins <= least + max(2, demand[15:].sum() * 0.7)
    assert places(patterns) == [] if not demand.any() else places(patterns)


def test_every_id_lies_in_one_place(docs):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (7, "word " * 259), (7, "word " * 259), (102, "long " * 9000)]
    found = pack_documents(docs(*rows), PATH).collect()
    plain = Tokenizer.from_file(PATH)
    whole = {(d, len(ids)): ids for d, t in rows for ids in [[*plain.encode(t or "", add_special_tokens=False).ids, 1]]}
    assert sum(r["length"] for r in found) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    sequences = defaultdict(list)
    for r in found:
        ids = whole[(r["doc_id"], r["doc_tokens"])][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"] and len(ids) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    tokens = sum(r["length"] for r in found)
    assert len(sequences) <= tokens / 2048 * 1.03 + 2


def test_empty_table(docs):
    assert pack_documents(docs(), PATH).count() == 0
