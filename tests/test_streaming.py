"""Streams over files in several batches agree with the batch folds."""

import datetime as dt
import os
import random

from tastegraph.operators.events import apply_watch_events, count_views, sliding_limit, status_transitions
from tastegraph.plans import store
from tastegraph.sources.payloads import raw_capture
from tastegraph.streaming.folds import capture_stream, limiter_stream, transitions_stream, views_stream, watch_stream
from tastegraph.tables import Tables

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, account_id long, title_id long, occurred_at timestamp, status string"


def land(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def transitions(spark, tmp_path, batches):
    stream = land(spark, tmp_path / "in", batches, SCHEMA)
    transitions_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), True).awaitTermination(120)
    cols = ["event_id", "from_status", "to_status"]
    logged = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()}
    late = {r["event_id"] for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out_late")).collect()}
    return logged, late


def event(n, minute, status, title=1):
    return (n, 1, title, DAY + dt.timedelta(minutes=minute), status)


def test_batches_in_order_log_what_the_batch_fold_logs(spark, tmp_path):
    batches = [[event(1, 0, "watchlist"), event(2, 5, "watching", 2)], [event(3, 9, "watching"), event(4, 9, "watching", 2)], [event(5, 20, "watched"), event(6, 30, "watched", 2)]]
    logged, late = transitions(spark, tmp_path, batches)
    rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = {(r["event_id"], r["from_status"], r["to_status"]) for r in status_transitions(rows).collect()}
    assert logged == want and not late


def test_a_late_event_goes_aside(spark, tmp_path):
    batches = [[event(1, 0, "watchlist"), event(3, 20, "watched")], [event(2, 10, "watching")]]
    logged, late = transitions(spark, tmp_path, batches)
    assert logged == {(1, None, "watchlist"), (3, "watchlist", "watched")} and late == {2}


def test_limiter_counts_across_batches(spark, tmp_path):
    schema = "hit_id long, bucket string, ts timestamp"
    hits = [(i, "b", DAY + dt.timedelta(seconds=7 * i)) for i in range(40)]
    stream = land(spark, tmp_path / "in", [hits[:15], hits[15:30], hits[30:]], schema)
    limiter_stream(stream, 5, 60, str(tmp_path / "out"), str(tmp_path / "check"), True).awaitTermination(120)
    whole = sliding_limit(spark.createDataFrame(hits, schema), 5, 60)
    got, want = spark.read.parquet(str(tmp_path / "out")).drop("v"), whole
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def ran(query):
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def folded(spark, rows):
    return {(r["event_id"], r["from_status"], r["to_status"]) for r in status_transitions(spark.createDataFrame(rows, SCHEMA)).collect()}


def logged_rows(spark, tmp_path):
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "from_status", "to_status").collect()]


def shuffled_events(n=120, titles=5):
    """Events whose arrival is up to ten minutes out of order."""
    rng = random.Random(1)
    rows = [event(i, i, rng.choice(["watchlist", "watching", "watched", "removed"]), rng.randrange(titles)) for i in range(n)]
    return rows, sorted(rows, key=lambda r: r[0] + rng.uniform(0, 10))


def test_any_order_within_the_delay_logs_what_the_batch_fold_logs(spark, tmp_path):
    rows, arrived = shuffled_events()
    end = [(1000, 9, 9, DAY + dt.timedelta(days=1), "watched")]
    batches = [arrived[at : at + 30] for at in range(0, 120, 30)] + [end, [(1001, 9, 9, DAY + dt.timedelta(days=2), "watched")]]
    stream = land(spark, tmp_path / "in", batches, SCHEMA)
    ran(transitions_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), True, "12 minutes"))
    logged = logged_rows(spark, tmp_path)
    assert len(logged) == len(set(logged)) and set(logged) - {(1000, None, "watched")} == folded(spark, rows)
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "out_late")).count() == 0


def test_a_restart_from_the_checkpoint_logs_no_row_twice(spark, tmp_path):
    rows, arrived = shuffled_events()
    for part in (arrived[:50], arrived[50:], [(1000, 9, 9, DAY + dt.timedelta(days=1), "watched")]):
        stream = land(spark, tmp_path / "in", [part], SCHEMA)
        ran(transitions_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), True, "12 minutes"))
    logged = logged_rows(spark, tmp_path)
    assert len(logged) == len(set(logged)) and set(logged) - {(1000, None, "watched")} == folded(spark, rows)


def test_rows_behind_the_watermark_land_aside_and_a_batch_run_takes_them_in(spark, tmp_path):
    batches = [[event(1, 0, "watchlist"), event(3, 60, "watched")], [event(4, 90, "watched", 2)], [event(2, 5, "watching"), event(5, 85, "watching")],
               [(9, 9, 9, DAY + dt.timedelta(days=1), "watched")]]
    stream = land(spark, tmp_path / "in", batches, SCHEMA)
    ran(transitions_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), True, "10 minutes"))
    late = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out_late"))
    assert [r["event_id"] for r in late.collect()] == [2]
    assert set(logged_rows(spark, tmp_path)) >= {(1, None, "watchlist"), (3, "watchlist", "watched"), (5, "watched", "watching"), (4, None, "watched")}
    rows = spark.createDataFrame([r for b in batches[:2] for r in b] + [batches[2][1]], SCHEMA).unionByName(late.drop("v"))
    again = {(r["event_id"], r["from_status"]) for r in status_transitions(rows).collect()}
    assert {(2, "watchlist"), (3, "watching")} <= again


def test_limiter_takes_hits_out_of_order_and_forgets_old_buckets(spark, tmp_path):
    schema = "hit_id long, bucket string, ts timestamp"
    rng = random.Random(2)
    hits = [(i, f"b{i // 40}", DAY + dt.timedelta(seconds=7 * i)) for i in range(400)]
    arrived = sorted(hits, key=lambda h: h[0] * 7 + rng.uniform(0, 100))
    end = [(9000 + k, "end", DAY + dt.timedelta(days=1 + k)) for k in range(2)]
    stream = land(spark, tmp_path / "in", [arrived[at : at + 80] for at in range(0, 400, 80)] + [end[:1], end[1:]], schema)
    query = ran(limiter_stream(stream, 5, 60, str(tmp_path / "out"), str(tmp_path / "check"), True, "2 minutes"))
    want = sliding_limit(spark.createDataFrame(hits, schema), 5, 60)
    got = spark.read.parquet(str(tmp_path / "out")).drop("v").filter("bucket <> 'end'")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spark.read.schema(schema).parquet(str(tmp_path / "out_late")).count() == 0
    # ten buckets came by; those whose windows are over are gone
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) <= 6 and kept[-1] <= 2


VIEWS = "view_id long, slug string, user_agent string, ts timestamp"


def test_views_count_once_and_a_batch_run_again_changes_nothing(spark, tmp_path):
    shares = spark.createDataFrame([("a", None), ("b", None), ("c", DAY)], "slug string, revoked_at timestamp")
    view = lambda n, slug, agent="Mozilla": (n, slug, agent, DAY + dt.timedelta(minutes=n))
    batches = [[view(1, "a"), view(2, "b"), view(3, "a", "Googlebot/2.1")], [view(1, "a"), view(4, "a"), view(5, "c")], [view(6, "b"), view(4, "a")]]
    stream = land(spark, tmp_path / "in", batches, VIEWS)
    out = str(tmp_path / "out")
    ran(views_stream(stream, shares, out, str(tmp_path / "check"), True, buckets=3))
    want = {r["slug"]: r["view_count"] for r in count_views(spark.createDataFrame([r for b in batches for r in b], VIEWS).dropDuplicates(["view_id"]), shares).collect()}
    read = lambda: {r["slug"]: r["view_count"] for r in store.current(spark, out).collect()}
    assert read() == want == {"a": 2, "b": 2}
    # the commit of the last batch is lost: Spark runs it again
    last = max(int(name) for name in os.listdir(tmp_path / "check" / "commits") if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(tmp_path / "check" / "commits" / name)
    ran(views_stream(spark.readStream.schema(VIEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), shares, out, str(tmp_path / "check"), True, buckets=3))
    assert read() == want


def test_captured_payloads_equal_the_batch_and_leave_other_files_alone(spark, tmp_path):
    schema = "resource string, source_id string, variant string, payload string, fetched_at timestamp"
    row = lambda n, minute, text: ("movie", str(n), "base", text, DAY + dt.timedelta(minutes=minute))
    batches = [[row(n, 0, "first") for n in range(12)], [row(3, 5, "second"), row(3, 4, "older")], [row(3, 5, "second"), row(12, 1, "new"), row(5, -5, "stale")]]
    out = str(tmp_path / "out")

    def stamps():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(out) for f in names if f.startswith("part-")}

    seen = []
    for part in batches:
        ran(capture_stream(land(spark, tmp_path / "in", [part], schema), out, str(tmp_path / "check"), True, 8))
        seen.append(stamps())
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(tuple(r) for r in raw_capture(everything.limit(0), everything).collect())
    table = store.current(spark, out)
    assert sorted(tuple(r) for r in table.select(*everything.columns).collect()) == want
    # the second batch touched one bucket: all files of the first are as they were
    assert seen[0].items() <= seen[1].items() and len(seen[1]) == len(seen[0]) + 1


def test_watch_events_fan_out_batch_by_batch(spark, tmp_path):
    schema = "event_id long, account_id long, title_id long, occurred_at timestamp, stars double, watched_on date, date_precision string"
    rows = [(1, 1, 1, DAY, 4.5, None, None), (2, 1, 2, DAY + dt.timedelta(hours=1), None, None, "unknown")], [(3, 1, 1, DAY + dt.timedelta(days=2), 3.0, None, None)]
    out = str(tmp_path / "out")

    def tables(batch_id):
        state = spark.createDataFrame([], "account_id long, title_id long, status string, added_at timestamp, started_at timestamp, completed_at timestamp")
        viewing = spark.createDataFrame([], "account_id long, title_id long, episode_id long")
        if batch_id:
            state = spark.read.parquet(f"{out}/title_state/v={batch_id - 1}").select(*state.columns)
            viewing = spark.read.parquet(f"{out}/viewing/v={batch_id - 1}").selectExpr("account_id", "title_id", "CAST(NULL AS LONG) AS episode_id")
        return Tables(title_state=state, viewing=viewing)

    ran(watch_stream(land(spark, tmp_path / "in", rows, schema), tables, out, str(tmp_path / "check"), True))
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert {(r["event_id"], r["to_status"]) for r in read("state_event").collect()} == {(1, "watched"), (2, "watched")}
    assert {(r["id"], r["is_rewatch"]) for r in read("viewing").collect()} == {(1, False), (2, False), (3, True)}
    assert sorted(r["value"] for r in read("rating").collect()) == [6, 9]
    assert apply_watch_events(spark.createDataFrame(rows[0], schema), tables(0))["title_state"].count() == 2
