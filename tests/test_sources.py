"""Files that are written, pruned, exported and refused: what lies there before and after."""

import datetime as dt
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tastegraph.operators import edges as E
from tastegraph.operators import metrics
from tastegraph.operators import validate as V
from tastegraph.sources import export, payloads

DAY = dt.datetime(2024, 3, 1)
AS_OF = "2024-06-01 12:00:00"


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_expired_days_go_with_their_folders_and_no_other_is_rewritten(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [(f"{day}", DAY + dt.timedelta(days=day, hours=h)) for day in range(0, 9) for h in (1, 13)]
    payloads.write_payloads(spark.createDataFrame(rows, "source_id string, fetched_at timestamp"), path)
    before = files(path)
    payloads.prune_payload_folders(spark, path, AS_OF, days=90)  # the limit is noon of 3 March
    after = files(path)
    days = lambda found: {f.split("fetched_on=")[1][:10] for f in found}
    assert days(before) == {f"2024-03-0{d}" for d in range(1, 10)} and days(after) == {f"2024-03-0{d}" for d in range(3, 10)}
    assert {f: m for f, m in before.items() if not f.split("fetched_on=")[1] < "2024-03-04"} == {f: m for f, m in after.items() if "2024-03-03" not in f}
    kept = spark.read.parquet(path)
    want = payloads.prune_payloads(spark.createDataFrame(rows, "source_id string, fetched_at timestamp"), AS_OF, 90)
    assert {(r[0], r[1]) for r in kept.select(F.col("source_id").cast("string"), "fetched_at").collect()} == {tuple(r) for r in want.collect()}
    again = files(path)
    payloads.prune_payload_folders(spark, path, AS_OF, days=90)
    assert spark.read.parquet(path).count() == 13 and set(days(again)) == days(files(path))


@pytest.mark.parametrize("text, failed", [
    ('{"id": 1, "title": "a", "credits": {"cast": [{"id": 1}, {"id": 2}]}}', None),
    ('{"id": 1, "title": "a", "credits": {"cast": [{"id": 1}, {"id": 2}, {"id": 3}, {"name": "x"}]}}', "credits.cast[3].id"),
    ('{"id": 1, "title": "a", "credits": {"cast": [{"id": "no number"}, {"id": 2}, {"id": null}]}}', "credits.cast[0].id,credits.cast[2].id"),
    ('{"id": 1, "credits": {"cast": []}}', "title"),
    ('{"id": "x", "title": null}', "id,title"),
    ('{"id": 1, "title": "a", "seasons": [{"number": 1, "episodes": [{"id": 5}]}, {"number": 2, "episodes": [{"id": 6}, {}]}]}', "seasons[1].episodes[1].id"),
    ('{"id": 1, "title": "a"', "$"), ("", "$"), (None, "$")])
def test_rejects_say_where_they_fail(spark, text, failed):
    schema = "id bigint, title string, credits struct<cast:array<struct<id:bigint,name:string>>>, seasons array<struct<number:int,episodes:array<struct<id:bigint>>>>"
    good, bad = payloads.split_rejects(spark.createDataFrame([(text,)], "payload string"), schema, ["id", "title", "credits.cast[].id", "seasons[].episodes[].id"])
    assert [r["failed_at"] for r in bad.collect()] == ([failed] if failed else []) and good.count() == (failed is None)


def test_json_export_reads_back(spark, t, tmp_path):
    accounts = t.account.select(F.col("id").alias("account_id")).orderBy("account_id").limit(3)
    ids = [r[0] for r in accounts.collect()]
    export.export_json(t, accounts, str(tmp_path), AS_OF, buckets=4)
    sets = export.export_sets(t, accounts, AS_OF)
    assert set(os.listdir(tmp_path)) == set(sets)
    for name, rows in sets.items():
        lines = [json.loads(line) for d, _, names in os.walk(tmp_path / name) for f in names if f.startswith("part-") for line in open(os.path.join(d, f), encoding="utf-8")]
        assert Counter(x["account_id"] for x in lines) == Counter(r["account_id"] for r in rows.select("account_id").collect())
        assert {x["account_id"] for x in lines} <= set(ids)
        # every field that is not NULL is there, in its own form
        want = Counter(r[0] for r in rows.select(F.to_json(F.struct(*rows.columns))).collect())
        assert Counter(json.dumps(x, sort_keys=True) for x in lines) == Counter(json.dumps(json.loads(w), sort_keys=True) for w in want.elements())


def test_csv_bytes(spark, tmp_path):
    columns = ", ".join(f"{c} string" for c in export.CSV_COLUMNS)
    row = ["Say \"hi\", ok", "1999", "4.5", None, "false", "two\nlines; yes", "watched", "true", "movie", "1", "0", "2024-01-02", ""]
    rows = spark.createDataFrame([(1, 7, *row), (1, 8, "B", *[None] * 12)], f"account_id long, title_id long, {columns}")
    export.write_titles_csv(rows, str(tmp_path / "csv"))
    parts = sorted(files(tmp_path / "csv"))
    assert all("account_id=1" in p for p in parts)
    header = ",".join(f'"{c}"' for c in export.CSV_COLUMNS)
    fields = ['"B"'] + ['""'] * 12, ['"Say ""hi"", ok"', *[f'"{v or ""}"' for v in row[1:]]]
    assert b"".join(open(p, "rb").read() for p in parts) == "".join(line + "\r\n" for line in (header, *[",".join(f) for f in fields])).encode()


def test_metrics_may_name_semantic_views_only(spark):
    view = spark.range(1)
    good, bad = metrics.Metric("m", "user_title", "count(*)", "none"), metrics.Metric("m", "title_state", "count(*)", "none")
    assert metrics.check_source(good, {"user_title": view}) is view
    with pytest.raises(ValueError, match="title_state"):
        metrics.check_source(bad, {"user_title": view})


def test_bad_declarations_are_told(t):
    meta, c = t.predicate_meta, F.col
    assert V.check_ontology(meta).count() == 0
    names = [r["predicate"] for r in meta.filter("not is_structural and not is_symmetric").orderBy("predicate").limit(6).collect()]
    change = lambda name, column, value: F.when(c("predicate") == name, value).otherwise(c(column))
    bad = meta.withColumns({
        "domain": change(names[0], "domain", F.array(F.lit("planet"))), "path_weight": change(names[1], "path_weight", F.lit(0).cast("double")),
        "is_symmetric": change(names[2], "is_symmetric", F.lit(True)), "narration": change(names[3], "narration", F.lit("no places")),
        "inverse": F.when(c("predicate") == names[4], names[5]).otherwise(c("inverse"))})
    found = {(r["rule"], r["key"]) for r in V.check_ontology(bad).collect()}
    assert found == {("known_type", names[0]), ("weight", names[1]), ("symmetric_inverse", names[2]), ("narration", names[3]), ("inverse_is_predicate", names[4])}
    twice = meta.withColumn("inverse", change(names[0], "inverse", F.lit(meta.filter(c("predicate") == names[1]).first()["inverse"])))
    assert [r["rule"] for r in V.check_ontology(twice).collect()] == ["inverse_unique"]


def test_kept_degrees_equal_a_recount(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "degree")
    held, plain = [], spark.createDataFrame([], "node_type string, node_id long, degree long")
    make = lambda rows: spark.createDataFrame(rows, "subject_type string, subject_id long, object_type string, object_id long")
    for change in range(4):
        gone = rng.sample(held, len(held) // 3)
        for row in gone:
            held.remove(row)
        new = [("person", rng.randrange(12), "title", rng.choice([1, rng.randrange(200)])) for _ in range(60)]
        held += new
        E.keep_degree(path, make(new), make(gone), change, buckets=5)
        if change == 2:
            E.keep_degree(path, make(new), make(gone), change, buckets=5)  # made again
        plain = E.update_degree(plain, make(new), make(gone))
        want = {tuple(r) for r in E.node_degree(make(held)).collect()}
        assert {tuple(r) for r in E.kept_degree(spark, path).select("node_type", "node_id", "degree").collect()} == want
        assert {tuple(r) for r in plain.select("node_type", "node_id", "degree").collect()} == want
