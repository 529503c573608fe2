import math
import random

import numpy as np
import pytest

from tastegraph.llm import negatives
from tastegraph.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, kind string, unit int"
TOP = 2**63 - 1


def brute(rows, every=100):
    """Every anchor against every row, in whole numbers of Python."""
    held = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        q = [min(max(math.floor(256 * float(np.float32(x))), -TOP - 1), TOP) for x in vector]
        held[vec_id] = min(held.get(vec_id, (label, q)), (label, q))
    out = []
    for a, (label, q) in held.items():
        if a % every:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(q, r, strict=True)), -TOP - 1), TOP), b, other) for b, (other, r) in held.items() if b != a and len(r) == len(q))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, positive, k, n, -p, -s) for k, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame([(*r, 0.5, "k", 3) for r in rows], SCHEMA), **how).collect())


def some(rng, n, size=24, labels=4, start=0):
    centre = [[rng.gauss(0, 0.4) for _ in range(size)] for _ in range(3)]
    return [(start + k, [c + rng.gauss(0, 0.15) for c in centre[rng.randrange(3)]], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("block, group, stripes", [(4096, 4096, 32), (50, 3, 4)])
def test_equal_to_brute_force(spark, monkeypatch, block, group, stripes):
    for name, value in (("BLOCK", block), ("GROUP", group), ("STRIPES", stripes)):
        monkeypatch.setattr(negatives, name, value)
    rows = some(random.Random(2), 1300, start=-200)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(random.Random(3), 300) + [
        (400, None, 1), (500, [0.1] * 24, None), (600, [nan] + [0.1] * 23, 1), (700, [inf] + [0.1] * 23, 1), (800, [None] + [0.1] * 23, 1), (None, [0.1] * 24, 1)]
    want = brute(rows)
    assert mined(spark, rows) == want and {r[0] for r in want} <= {0, 100, 200}


def test_copies_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    common = [rng.gauss(0, 0.3) for _ in range(24)]
    rows = some(rng, 200) + [(1000 + k, common, k % 3) for k in range(400)]
    want = brute(rows)
    assert any(r[4] == r[5] for r in want) and mined(spark, rows + rows[100:500] + [(1100, [9.0] * 24, 9)]) == want


def test_other_lengths_and_large_components(spark):
    rng = random.Random(5)
    rows = some(rng, 150, size=5) + some(rng, 150, size=9, start=1000) + [(200, [], 1), (202, [], 2), (203, [], 1), (3000, [1e30, 2.0, -3e8, 1.0, 1.0], 2)]
    rows += [(4000 + 50 * k, [1e5 * k, 2.0, -3e4, 1.0, 7e6], k % 2) for k in range(9)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(7, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_scan_drops_and_keeps(monkeypatch):
    rng = np.random.default_rng(1)
    block = negatives.Block(np.arange(500), np.zeros(500, np.int64), rng.integers(-100, 100, (500, 40)))
    a = rng.integers(-100, 100, 40)
    scores = block.columns.T @ a
    least = int(np.sort(scores)[-7])
    places, found = negatives.scan(block, a, np.argsort(-np.abs(a)), np.ones(500, bool), lambda lower, upper: upper >= least)
    assert sorted(places.tolist()) == np.flatnonzero(scores >= least).tolist() and (found == scores[places]).all()
