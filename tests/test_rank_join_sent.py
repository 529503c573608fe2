"""What a rank join sends grows with the rows where alike rows lie near each other."""

import numpy as np
import pyarrow as pa

from tastegraph.plans import rankjoin

HELD = "array<struct<key: long, pooled: boolean, weight: double, value: double>>"


def test_rows_far_off_are_sent_only_if_they_may_help(spark, monkeypatch):
    monkeypatch.setattr(rankjoin, "GROUP", 40)
    sent, met = [], rankjoin._met

    def counted(frames, units, k):
        sent.append(sum(f.filter(f.kind != rankjoin.FAR).count() for f in frames))
        return met(frames, units, k)

    monkeypatch.setattr(rankjoin, "_met", counted)
    # a key of its own for every thirty ids, and one weak key that all hold
    rows = [(i, [(1000 + i // 30, False, 3.0, 1.0), (1, False, 0.5, 1.0)]) for i in range(1200)]
    found = {tuple(r) for r in rankjoin.strongest_partners(spark.createDataFrame(rows, f"id long, held {HELD}"), 2).collect()}
    assert {p for i, p in found if i == 605} == {600, 601, 606, 607}
    assert sum(sent) < 8 * len(rows)


def test_one_pooled_key_opens_no_group():
    keys = pa.array([[{"key": 5, "pooled": True, "weight": 1.0, "value": 1.0}]], pa.list_(pa.struct(
        [("key", pa.int64()), ("pooled", pa.bool_()), ("weight", pa.float64()), ("value", pa.float64())])))
    group = rankjoin._Group([rankjoin._Rows(pa.RecordBatch.from_arrays([pa.array([3]), keys], ["id", "held"]))], 2)
    assert not group.may_gain(np.array([5, 6]), np.array([1.0, 1.0]), 10, 20)
