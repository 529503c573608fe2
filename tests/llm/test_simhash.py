import random
import re

import numpy as np
import pytest
import xxhash

from tastegraph.llm import simhash
from tastegraph.llm.simhash import near_fingerprints


def hashed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(prints, radius=2):
    """Smallest id reachable, over all pairs."""
    parent = {d: d for d, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (d, f) in enumerate(prints):
        for e, g in prints[:k]:
            if (f ^ g).bit_count() <= radius:
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: root(d) for d, _ in prints}


def test_equal_to_brute_force(docs):
    rng = random.Random(5)
    rows, word = [], lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    for group in range(25):
        base = [word() for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            rows.append((1000 - len(rows) * 3, " ".join(own)))
    rows += [(2001, None), (2000, ""), (2002, " \n\t"), (2003, "One"), (2004, "one"), (2005, "one TWO"), (2006, "a b\x0bc"), (2007, "É a b"), (2008, "é a b")]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in near_fingerprints(docs(*rows)).collect()}
    prints = [(d, hashed(t)) for d, t in rows]
    want = brute(prints)
    assert got == {d: (f, want[d]) for d, f in prints}


def flipped(rng, f, n):
    for k in rng.sample(range(64), n):
        f ^= 1 << k
    return f


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 9])
@pytest.mark.parametrize("size", [1, 2, 64, 65, 700])
def test_planes_find_what_bit_counts_find(radius, size, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 500)
    rng = random.Random(size * 10 + radius)
    groups = []
    for n in (size, 3, 1, 130):
        g = [rng.getrandbits(64)]
        while len(g) < n:
            g.append(flipped(rng, rng.choice(g), rng.randint(0, radius + 3)) if rng.random() < 0.8 else rng.getrandbits(64))
        groups.append(g)
    first = simhash.leaders(np.array(sum(groups, []), np.uint64), np.array([len(g) for g in groups]), radius, list(range(64)))
    at = 0
    for g in groups:
        want = brute(list(enumerate(g)), radius)
        assert (first[at : at + len(g)] - at).tolist() == [want[k] for k in range(len(g))]
        at += len(g)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_crowded_buckets_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(40)]
    while len(prints) < 300:
        prints.append(flipped(rng, rng.choice(prints), rng.choice([1, 2, 2, 3])))
    rows = list(enumerate(dict.fromkeys(prints)))
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in rows], "node long, bits long")
    edges = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    want, parent = brute(rows), {k: k for k, _ in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {k: root(k) for k, _ in rows} == want


def test_repeated_and_nameless_rows(docs):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "x y z q"), (5, "x y z q"), (9, long), (None, long), (3, "other words stand here"), (9, "other words stand here")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_fingerprints(docs(*rows)).collect()), key=repr)
    assert got == [(3, 3), (5, 5), (5, 5), (9, 3), (9, 3), (None, None)]


def test_empty_table(docs):
    assert near_fingerprints(docs()).count() == 0
