"""Bounds on path search cut work and no path."""

import random

from pyspark.sql import functions as F

from tastegraph.operators import paths as P


def hub_graph(spark, two_hops=70, side=120, seed=3):
    """A and B with many cheap middles, and many dear ones beyond that only three hops reach."""
    rng = random.Random(seed)
    rows = []

    def edge(a, b, weight):
        rows.append(("t", a, "t", b, "p", "l", False, weight, 1.0, False))

    for m in range(two_hops):
        edge(0, 100 + m, 1.0 + rng.random() / 10)
        edge(100 + m, 1, 1.0 + rng.random() / 10)
    for m in range(side):
        edge(0, 1000 + m, 3.0)
        edge(2000 + m, 1, 3.0)
        for other in rng.sample(range(side), min(40, side)):
            edge(1000 + m, 2000 + other, 2.0)
    edge(0, 5000, 0.1)  # a cheap way of three hops
    edge(5000, 5001, 0.1)
    edge(5001, 1, 0.1)
    eb = spark.createDataFrame(rows, """subject_type string, subject_id long, object_type string, object_id long, canonical_predicate string,
        predicate_label string, is_inverse boolean, path_weight double, confidence double, excluded_from_path_intermediates boolean""")
    degree = spark.createDataFrame([("t", i, 2) for r in rows for i in (r[1], r[3])], "node_type string, node_id long, degree long").distinct()
    return spark.createDataFrame([(7, "t", 0, "t", 1)], "pair_id long, a_type string, a_id long, b_type string, b_id long"), eb, degree


def test_bounds_cut_ways_but_no_ranked_path(spark):
    f = P.frontiers(*hub_graph(spark))
    two = P.paths2(f)
    bound = P.cost_bound(P.top_rows(two, ["pair_id"], [F.col("cost")], 60))
    free, cut = P.ways(f).count(), P.ways(f, bound).count()
    assert free >= 4800 and cut * 10 <= free
    plain = [tuple(r) for r in P.cheapest(two.unionByName(P.paths3(f))).orderBy("rank").select("rank", "len", "cost", "steps").collect()]
    bounded = [tuple(r) for r in P.rank_paths(f).orderBy("rank").select("rank", "len", "cost", "steps").collect()]
    assert plain == bounded and len(bounded) == 60 and bounded[0][1] == 3


def test_a_pair_with_few_paths_is_not_bounded(spark):
    f = P.frontiers(*hub_graph(spark, two_hops=5, side=20))
    ranked = P.rank_paths(f).collect()
    assert len(ranked) == 60 and sum(r["len"] == 2 for r in ranked) == 5
