"""Edges of the nodes asked about meet in parts of bounded size, and every edge meets its declaration where it stands."""

from pyspark.sql import functions as F

from tastegraph.operators import neighbourhood as N
from tastegraph.operators.edges import edge_bidirectional

PEOPLE = 2 * N.REFS_IN_PART + 100


def _graph(spark):
    """Person p is tied to titles p and p + 1, title t to person t and t - 1."""
    ends = spark.range(PEOPLE).select(F.col("id").alias("p"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("t"))

    def side(a, x, b, y):
        return ends.select(F.lit(a).alias("subject_type"), F.col(x).alias("subject_id"), F.lit("acted_in").alias("predicate"), F.lit(b).alias("object_type"),
                           F.col(y).alias("object_id"), (F.lit(1.0) + F.col("t") - F.col("p")).alias("path_weight"), F.lit("in").alias("predicate_label"))

    eb = side("person", "p", "title", "t").unionByName(side("title", "t", "person", "p"))
    degree = eb.groupBy(F.col("subject_type").alias("node_type"), F.col("subject_id").alias("node_id")).agg(F.count("*").alias("degree"))
    return spark.range(PEOPLE).select(F.lit("person").alias("node_type"), F.col("id").alias("node_id")), eb, degree


def test_rings_lie_in_parts_that_follow_the_nodes_asked_about(spark):
    refs, eb, degree = _graph(spark)
    one = N.ring1(refs, eb)
    two = N.ring2(refs, one, eb, degree)
    assert one.rdd.getNumPartitions() == two.rdd.getNumPartitions() == 3
    assert {(r.ref_id, r.id, r.path_weight) for r in one.collect()} == {(p, p + i, 1.0 + i) for p in range(PEOPLE) for i in (0, 1)}
    assert {(r.ref_id, r.id) for r in two.collect()} == {(p, q) for p in range(PEOPLE) for q in (p - 1, p, p + 1) if 0 <= q < PEOPLE}


def test_neighbours_in_several_parts(spark):
    refs, eb, degree = _graph(spark)
    node = spark.range(PEOPLE).select(F.lit("title").alias("node_type"), "id", *[F.lit("x").alias(n) for n in ("slug", "label", "sublabel", "image_path")],
                                      F.lit(1.0).alias("popularity"))
    got = {(r.ref_id, r.object_id, r.rn, r.more) for r in N.neighbors(refs, eb, node, degree, per_group=1).collect()}
    assert got == {(p, p, 1, 1 if p + 1 < PEOPLE else 0) for p in range(PEOPLE)}


def test_edges_do_not_travel_to_their_declaration(spark, t):
    plan = edge_bidirectional(t.edge.withColumn("attributes", F.struct("salience")), t.predicate_meta)
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
