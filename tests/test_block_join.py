"""Partners by rare keys in blocks of ids and by common ones beside them are those of all pairs, scores and reasons included."""

import random

import pytest

from tastegraph.operators.similarity import JUDGE
from tastegraph.plans import blockjoin, rankjoin

# crew with three marks, themes (pooled), cast, franchise with a fixed strength
SIGNAL = {key: key % 4 for key in range(90)}
MARK = {key: key // 4 % 3 if key % 4 == 0 else 0 for key in range(90)}
WEIGHT = {key: [2.0, 1.25, 0.5, 0.0][key % 7 % 4] for key in range(90)}
NAMES = [["crew", "writer", "director"], ["theme"], ["cast"], ["franchise"]]


def judged(mine, theirs):
    """Score and reason of two rows {key: value}, None where nothing shared counts."""
    sums, marks = {}, {}
    for key in mine.keys() & theirs.keys():
        s, (a, b) = SIGNAL[key], (mine[key], theirs[key])
        sums.setdefault(s, []).append(WEIGHT[key] * (min(a, b) if s == 1 else a * b))
        marks[s] = max(marks.get(s, 0), MARK[key])
    if len(sums.get(1, [])) < 2:
        sums.pop(1, None)
    if not sums:
        return None
    strength = {s: 4.0 if s == 3 else round(sum(v), 9) for s, v in sums.items()}
    return round(sum(map(sum, sums.values())), 9), min((-v, NAMES[s][marks[s]]) for s, v in strength.items())[1]


def wanted(rows, k):
    found = set()
    for x, held in rows.items():
        for side in (-1, 1):
            met = [(judged(held, other), y) for y, other in rows.items() if (y - x) * side > 0]
            best = sorted((-j[0], y, j[1]) for j, y in met if j is not None)[:k]
            found |= {(min(x, y), max(x, y), -s, r) for s, y, r in best}
    return found


@pytest.mark.parametrize("common, share, block, cells, table, ways", [
    (10**6, 1, 10**5, 10**6, 10**6, 9), (30, 10**6, 40, 50, 10**6, 10**4), (30, 10**6, 40, 50, 10**6, 3), (10, 10**6, 70, 300, 1, 10**4), (-1, 10**6, 70, 300, 1, 10**4)])
def test_blocks_equal_all_pairs(spark, monkeypatch, common, share, block, cells, table, ways):
    for name, value in (("COMMON", common), ("SHARE", share), ("BLOCK", block), ("CELLS", cells), ("TABLE", table), ("WAYS", ways)):
        monkeypatch.setattr(blockjoin, name, value)
    monkeypatch.setattr(rankjoin, "GROUP", 60)
    rng = random.Random(11)
    rows = {}
    for i in range(200):
        held = {key for key in range(40) if rng.random() < 0.4 / (1 + key % 5)} | set(rng.sample(range(40, 90), 2))
        rows[i * 3 - 100] = {key: rng.choice([0.5, 1.0, 2.0]) for key in held}
    rows[200], rows[201], rows[203] = dict.fromkeys(range(40), 1.0), {}, {0: 1.0}
    data = [(x, [(key, SIGNAL[key] == 1, WEIGHT[key], v, SIGNAL[key], MARK[key]) for key, v in held.items()]) for x, held in rows.items()]
    df = spark.createDataFrame(data, f"id long, held {blockjoin.HELD}")
    for k in (1, 4):
        assert {tuple(r) for r in blockjoin.strongest_scored(df, k, JUDGE).collect()} == wanted(rows, k)


def test_what_rows_hold_is_not_joined_to_their_pairs(spark):
    # pairs leave their task scored: the plan joins rows with the small table of units alone
    rows = [(i, [(i // 4, False, 1.0, 1.0, 0, 2), (1000 + i // 6, False, 2.0, 1.0, 2, 0)]) for i in range(600)]
    df = blockjoin.strongest_scored(spark.createDataFrame(rows, f"id long, held {blockjoin.HELD}"), 2, JUDGE)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1 and df.count() > 0


def test_copies_hold_common_keys_in_one_way(spark, monkeypatch):
    monkeypatch.setattr(blockjoin, "BLOCK", 100)
    rows = [(i, [(1, False, 1.0, 1.0, 0, 2), (2, True, 1.0, 1.0, 1, 0), (3, True, 0.5, 1.0, 1, 0)]) for i in range(2600)]
    found = {tuple(r)[:2] for r in blockjoin.strongest_scored(spark.createDataFrame(rows, f"id long, held {blockjoin.HELD}"), 2, JUDGE).collect()}
    assert found == {(x, y) for x in range(2600) for y in (x + 1, x + 2) if y < 2600} | {(x, y) for y in range(2600) for x in (0, 1) if x < y}
