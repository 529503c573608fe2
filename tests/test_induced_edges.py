"""Edges among a centre and its rings, whichever end is the crowded one."""

from tastegraph.operators import neighbourhood as N


def test_edges_inside_the_rings(spark):
    # person 1 has a hundred titles and concept 9 all of them; the ring of person 2 holds two titles, person 1 and the concept
    edges = [("person", 1, "title", i) for i in range(100)] + [("title", i, "concept", 9) for i in range(100)] + [("person", 2, "title", 5), ("title", 5, "title", 5)]
    rows = [(a, b, c, d, False, "p", 1.0) for a, b, c, d in edges] + [(c, d, a, b, True, "p", 1.0) for a, b, c, d in edges]
    eb = spark.createDataFrame(rows, "subject_type string, subject_id long, object_type string, object_id long, is_inverse boolean, canonical_predicate string, path_weight double")
    ring = spark.createDataFrame([("person", 2, kind, i) for kind, i in (("title", 5), ("title", 6), ("person", 1), ("concept", 9))],
                                 "ref_type string, ref_id long, node_type string, id long")
    got = {(r.source_type, r.source_id, r.target_type, r.target_id) for r in N.induced_edges(ring, eb).collect()}
    assert got == {("person", 1, "title", 5), ("person", 1, "title", 6), ("person", 2, "title", 5), ("concept", 9, "title", 5), ("concept", 9, "title", 6)}
    # rings meet edges at quiet ends only, not the hundred of person 1
    turned = N.by_quiet_end(N.forward_edges(eb))
    assert {r.q.t for r in turned.select("q").collect()} <= {"title", "person"} and turned.filter("q.t = 'person' and q.i = 1").count() == 0


def test_edges_and_rings_are_derived_once(spark):
    rows = [("title", 1, "x", "person", 2, False, "x", 1.0), ("person", 2, "y", "title", 1, True, "x", 1.0)]
    eb = spark.createDataFrame(rows, "subject_type string, subject_id long, predicate string, object_type string, object_id long, is_inverse boolean, canonical_predicate string, path_weight double")
    rings = spark.createDataFrame([("person", 2, "title", 1, 1)], "ref_type string, ref_id long, node_type string, id long, hop int")
    got = N.induced_edges(rings, eb)
    assert "LogicalRDD" not in got._jdf.queryExecution().analyzed().toString()
    assert [tuple(r)[2:] for r in got.collect()] == [("person", 2, "title", 1, "x", 1.0)]
