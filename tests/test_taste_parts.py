"""Affinity travels once, as lists of nodes, and is spelled out beside its account."""

import re

from pyspark.sql import functions as F

from tastegraph.demo.model import AS_OF
from tastegraph.operators import edges as E
from tastegraph.operators import taste as T
from tastegraph.operators import views as W


def shuffles_after_expansion(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "explode(nodes" in plan
    return len(re.findall(r"Exchange hashpartitioning", plan[: plan.index("explode(nodes")]))


def test_expanded_rows_are_not_shuffled(t):
    assert shuffles_after_expansion(W.user_taste_affinity(t, AS_OF)) == 0
    scores, _ = W.taste_parts(t, AS_OF)
    assert shuffles_after_expansion(T.suggestion_seeds(scores, t.predicate_meta)) == 0


def test_short_lists_and_small_parts_give_the_same_rows(t, monkeypatch):
    def rows(distinct):
        return sorted(map(repr, W.user_taste_affinity(E.graph(t), AS_OF, distinct).collect()))

    want = rows(False), rows(True)
    monkeypatch.setattr(W, "LINKS_IN_LIST", 1)
    monkeypatch.setattr(W, "WATCHED_IN_PART", 100)
    assert (rows(False), rows(True)) == want
    assert W.taste_parts(t, AS_OF)[0].rdd.getNumPartitions() > 2


def test_persona_expands_once(t, monkeypatch):
    calls = []
    real = T.taste_parts
    monkeypatch.setattr(T, "taste_parts", lambda *a, **k: calls.append(1) or real(*a, **k))
    plan = T.persona(t, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert len(calls) == 1 and "explode(nodes" not in plan  # spelled out once, before; only leads are left


def test_counted_candidates_equal_spelled_out_ones(spark):
    # node 1 is a seed by two relations; the library fills a list's front, its back, a gap, all of it
    links = [("x", 1, "a", i) for i in range(1, 9)] + [("x", 1, "b", i) for i in range(5, 13)] + [("y", 2, "a", i) for i in (3, 4)]
    eb = spark.createDataFrame([(*r[:3], "title", r[3]) for r in links], "subject_type string, subject_id long, canonical_predicate string, object_type string, object_id long")
    amounts = [("x", 1, "a", 2.0), ("x", 1, "b", 3.0), ("y", 2, "a", 1.0)]
    library = {1: [], 2: [1, 2, 4, 12], 3: [3, 4], 4: list(range(1, 13)), 5: [5, 6, 7, 8, 9], 6: [1, 12, 99]}
    seeds = spark.createDataFrame([(a, *s[:3], "l", 2, s[3], 1.0) for a in library for s in amounts if (a, s[0]) != (6, "y")],
                                  "account_id long, node_type string, node_id long, canonical_predicate string, label string, n_titles long, affinity_score double, path_weight double")
    degree = spark.createDataFrame([("x", 1, 1), ("y", 2, 1)], "node_type string, node_id long, degree long")
    held = spark.createDataFrame([(a, x) for a, xs in library.items() for x in xs], "account_id long, title_id long")
    cols = ["account_id", "node_type", "node_id", "predicate", "titles", "first_title", "last_title"]
    want = T.suggestion_candidates(seeds, eb, degree, held).groupBy(*cols[:4]).agg(
        F.count("*").alias("titles"), F.min("title_id").alias("first_title"), F.max("title_id").alias("last_title"))
    got = T.candidates_by_seed(seeds, eb, degree, held)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.count() > 8


def test_titles_of_accounts_are_not_broadcast(t):
    from tastegraph.operators.views import user_core

    plan = user_core(t)._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("SortMergeJoin" in line for line in semi)
