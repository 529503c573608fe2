"""Busy groups take other ways through the jobs; the results must not change."""

import random

import pytest
from pyspark.sql import functions as F

from tastegraph.demo.model import AS_OF
from tastegraph.operators import edges as E
from tastegraph.operators import similarity as S
from tastegraph.operators import taste as T
from tastegraph.operators import views as W
from tastegraph.plans import rankjoin, slices
from tastegraph.plans.rankjoin import strongest_partners

c = F.col


def partners(rows, k):
    """The k strongest partners on either side of every row of (id, {key: (pooled, weight, value)}), over all pairs."""
    found = set()
    for x, held in rows.items():
        for side in (-1, 1):
            scored = []
            for y, other in rows.items():
                if (y - x) * side <= 0:
                    continue
                both = [(p, w * (min(v, other[key][2]) if p else v * other[key][2])) for key, (p, w, v) in held.items() if key in other]
                pooled, plain = [a for p, a in both if p], [a for p, a in both if not p]
                if plain or len(pooled) > 1:
                    scored.append((-round(sum(plain) + (sum(pooled) if len(pooled) > 1 else 0), 9), y))
            found |= {(x, y) for _, y in sorted(scored)[:k]}
    return found


def joined(spark, rows, k):
    data = [(x, [(key, *v) for key, v in held.items()]) for x, held in rows.items()]
    df = spark.createDataFrame(data, "id long, held array<struct<key: long, pooled: boolean, weight: double, value: double>>")
    return {tuple(r) for r in strongest_partners(df, k).collect()}


@pytest.mark.parametrize("group, stripes, block, cells", [(8192, 8, 2048, 10**6), (40, 3, 7, 60)])
def test_rank_join_equals_all_pairs(spark, monkeypatch, group, stripes, block, cells):
    for name, value in (("GROUP", group), ("STRIPES", stripes), ("BLOCK", block), ("CELLS", cells)):
        monkeypatch.setattr(rankjoin, name, value)
    rng = random.Random(7)
    # a key for a third of all rows and more, rare keys, weight zero; one row holds 40 common keys
    keys = {key: (key % 3 == 0, [2.0, 1.25, 0.5, 0.0][key % 4]) for key in range(90)}
    rows = {}
    for i in range(260):
        held = {key for key in range(40) if rng.random() < 0.33 / (1 + key % 5)} | set(rng.sample(range(40, 90), 2))
        rows[i * 3 - 100] = {key: (*keys[key], rng.choice([0.5, 1.0, 2.0])) for key in held}
    rows[200] = {key: (*keys[key], 1.0) for key in range(40)}
    rows[201], rows[203] = {}, {0: (*keys[0], 1.0)}
    for k in (1, 4):
        assert joined(spark, rows, k) == partners(rows, k)


def test_copies_keep_the_nearest_ids(spark):
    rows = {i: {1: (False, 1.0, 1.0), 2: (True, 1.0, 1.0), 3: (True, 1.0, 1.0)} for i in range(0, 900, 2)}
    assert joined(spark, rows, 3) == partners(rows, 3)
    assert joined(spark, {}, 3) == set()


@pytest.mark.parametrize("signals", [("theme", "franchise"), S.SIGNALS])
def test_strongest_pairs_of_the_model(t, signals):
    rows = {}
    for r in S.signal_features(t, signals).collect():
        rows.setdefault(r["title_id"], {})[r["key"]] = (r["signal"] == "theme", r["weight"], r["value"])
    want = {(min(p), max(p)) for p in partners(rows, 3)}
    assert {(r["x"], r["y"]) for r in S.strongest_pairs(t, signals, k=3).collect()} == want and want


def test_crowded_seeds_give_the_same_suggestions(t):
    g = E.graph(t)
    seeds = T.suggestion_seeds(W.user_taste_affinity(g, AS_OF), t.predicate_meta).filter(c("account_id") < 1e9)
    cols = ["account_id", "title_id", F.round("score", 6), "seeds"]

    def run(hub):
        return {tuple(r) for r in T.ranked_suggestions(seeds, g.edge_both, g.degree, t.title_state, hub, 4).select(*cols).collect()}

    assert run(10**9) == run(25)


def test_sliced_windows(spark):
    rows = [(k, (i * 37) % 500) for k in (1, 2) for i in range(300)] + [(3, 7)]
    df = spark.createDataFrame(rows, "k int, x int").distinct()
    by = F.floor(c("x") / 20)
    nxt = slices.with_next(df, ["k"], by, [c("x")], c("x"), "nxt")
    got = slices.with_rank(nxt, ["k"], by, [c("x")], "rn").collect()
    for k in (1, 2, 3):
        xs = sorted({x for kk, x in rows if kk == k})
        want = {x: (xs[i + 1] if i + 1 < len(xs) else None, i + 1) for i, x in enumerate(xs)}
        assert {r.x: (r.nxt, r.rn) for r in got if r.k == k} == want
