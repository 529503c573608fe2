"""Streaming twins of the event folds, on Spark's keyed state.

``fold_status`` aggregates, so Structured Streaming runs it as it is. Transitions and the limiter look back: they keep a small state for
each key in Spark's state store and let event-time timers release what waits and drop what is over. Each micro-batch is written under
its number, so a batch that is run again after a lost executor or driver writes the same rows to the same place.

With a ``delay``, rows wait in their key's state until the watermark has passed them and are then folded in order: any order of arrival
within the delay gives what the batch fold gives. Without one, rows are folded as they come. Rows that come behind the watermark, or
behind what their key has already folded, cannot be folded without changing what was written: they go aside, to ``<out>_late``, and a batch
run over both takes them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tastegraph.operators.events import KEY, REMOVED, apply_watch_events, live_views
from tastegraph.plans.store import upsert
from tastegraph.tables import Tables


def latest_status(events: DataFrame) -> DataFrame:
    """Running state per account and title over an endless stream; removals are left to the batch fold."""
    from tastegraph.operators.events import _summary

    return _summary(events)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _timed(stream: DataFrame, column: str, delay: str | None) -> DataFrame:
    """The stream under a watermark, its time as ``at`` in microseconds.

    Spark drops rows behind the watermark unseen. So each row goes on without a time, and beside it one that moves the watermark and ends
    there: what is late is judged, and kept, by the fold.
    """
    moved = stream.withColumn("at", F.unix_micros(F.col(column).cast("timestamp"))).withColumn(
        "clock", F.explode(F.array(F.col(column).cast("timestamp"), F.lit(None).cast("timestamp")))).drop(column)
    return moved.withWatermark("clock", delay or "0 seconds").filter("clock is null")


def _wait(state: GroupState, until_us: int) -> None:
    """Wake the key when the watermark has passed a time."""
    state.setTimeoutTimestamp(max(until_us // 1000, state.getCurrentWatermarkMs()) + 1)


def _columns(pdfs: Iterator[pd.DataFrame], names: list[str]) -> list[tuple]:
    return [row for pdf in pdfs for row in pdf[names].itertuples(index=False, name=None)]


def transitions_stream(events: DataFrame, out: str, checkpoint: str, available_now: bool = False, delay: str | None = None) -> StreamingQuery:
    """Log the status transitions of a stream, per account and title; ``<out>_late`` gets the rows that come too late.

    State of a key: its last status and the rows that wait; rows of one time are folded by event_id.
    """
    types = dict(events.dtypes)
    key_schema = ", ".join(f"{c} {types[c]}" for c in KEY)
    waiting = f"at array<long>, event_id array<{types['event_id']}>, status array<string>"
    state_schema = f"last_at long, last_id {types['event_id']}, last_status string, {waiting}"
    out_schema = f"{key_schema}, event_id {types['event_id']}, at long, from_status string, to_status string, late boolean"

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last_id, last, *waits = state.get if state.exists else (None, None, None, [], [], [])
        held, passed, rows = list(zip(*waits, strict=True)), state.getCurrentWatermarkMs() * 1000, []
        for row in _columns(pdfs, ["at", "event_id", "status"]) if not state.hasTimedOut else []:
            seen = last_at is not None and row[:2] < (last_at, last_id)
            if seen or delay is not None and row[0] < passed:
                rows.append((row[1], row[0], None, row[2], True))
            else:
                held.append(row)
        held.sort()
        ready = [row for row in held if delay is None or row[0] < passed]
        held = held[len(ready):]
        for at, event_id, status in ready:
            before = None if last == REMOVED else last
            if status not in (REMOVED, before):
                rows.append((event_id, at, before, status, False))
            last_at, last_id, last = at, event_id, status
        state.update((last_at, last_id, last, *([r[c] for r in held] for c in range(3))))
        if held:
            _wait(state, held[0][0])
        if rows:
            frame = pd.DataFrame(rows, columns=["event_id", "at", "from_status", "to_status", "late"])
            for name, value in zip(reversed(KEY), reversed(key), strict=True):
                frame.insert(0, name, value)
            yield frame

    told = _timed(events.select(*KEY, "event_id", "occurred_at", "status"), "occurred_at", delay).groupBy(*KEY).applyInPandasWithState(
        fold, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("occurred_at", F.timestamp_micros("at")).persist()
        rows.filter("not late").select(
            *KEY, "event_id", "occurred_at", F.lit("status_change").alias("event_kind"), "from_status", "to_status").write.mode(
            "overwrite").parquet(f"{out}/v={batch_id}")
        rows.filter("late").select("event_id", *KEY, "occurred_at", F.col("to_status").alias("status")).write.mode("overwrite").parquet(
            f"{out}_late/v={batch_id}")
        rows.unpersist()

    return _run(told, each, checkpoint, available_now)


def limiter_stream(hits: DataFrame, limit: int, window_seconds: int, out: str, checkpoint: str, available_now: bool = False,
                   delay: str | None = None) -> StreamingQuery:
    """Decide every hit of a stream; ``<out>_late`` gets hits of a time their bucket has already counted past.

    State of a bucket: the counts of its current and previous window and the hits that wait. It is dropped once the watermark has passed the
    window after its last hit's, when neither count can matter again.
    """
    types = dict(hits.dtypes)
    size = window_seconds * 1_000_000
    state_schema = f"window_no long, hits long, before long, last_at long, at array<long>, hit_id array<{types['hit_id']}>"
    out_schema = f"bucket {types['bucket']}, hit_id {types['hit_id']}, at long, allowed boolean, remaining int, retry_after_s int, late boolean"

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, before, last_at, *waits = state.get if state.exists else (None, 0, 0, None, [], [])
        held, passed, rows = list(zip(*waits, strict=True)), state.getCurrentWatermarkMs() * 1000, []
        for row in _columns(pdfs, ["at", "hit_id"]) if not state.hasTimedOut else []:
            if last_at is not None and row[0] < last_at or delay is not None and row[0] < passed:
                rows.append((row[1], row[0], None, None, None, True))
            else:
                held.append(row)
        held.sort()
        ready = [row for row in held if delay is None or row[0] < passed]
        held = held[len(ready):]
        for at, hit_id in ready:
            number = at // size
            if number != window:
                window, n, before = number, 0, n if window is not None and number == window + 1 else 0
            n, last_at = n + 1, at
            estimate = before * (1 - (at / size - number)) + n
            left = (number + 1) * window_seconds - at / 1_000_000
            rows.append((hit_id, at, estimate <= limit, max(0, limit - _ceil(estimate)), max(1, _ceil(left)), False))
        over = window is None or passed >= (window + 2) * size
        if held or not over:
            state.update((window, n, before, last_at, [r[0] for r in held], [r[1] for r in held]))
            _wait(state, held[0][0] if held else (window + 2) * size)
        elif state.exists:
            state.remove()
        if rows:
            frame = pd.DataFrame(rows, columns=["hit_id", "at", "allowed", "remaining", "retry_after_s", "late"]).astype(
                {"allowed": "boolean", "remaining": "Int32", "retry_after_s": "Int32"})
            frame.insert(0, "bucket", key[0])
            yield frame

    told = _timed(hits.select("bucket", "hit_id", "ts"), "ts", delay).groupBy("bucket").applyInPandasWithState(
        fold, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ts", F.timestamp_micros("at")).persist()
        rows.filter("not late").select("bucket", "hit_id", "ts", "allowed", "remaining", "retry_after_s").write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        rows.filter("late").select("bucket", "hit_id", "ts").write.mode("overwrite").parquet(f"{out}_late/v={batch_id}")
        rows.unpersist()

    return _run(told, each, checkpoint, available_now)


def _ceil(x: float) -> int:
    return -int(-x // 1)


def views_stream(views: DataFrame, shares: DataFrame, out: str, checkpoint: str, available_now: bool = False, delay: str = "1 hour",
                 buckets: int = 64) -> StreamingQuery:
    """Keep view counts of live shares up to date in a table at ``out`` (slug, view_count, batch).

    A view sent twice within the delay counts once, by view_id. Each micro-batch adds its counts to the rows of its slugs alone, and a batch
    that is run again finds its number there and adds nothing.
    """
    once = live_views(views.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["view_id"]), shares)

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.groupBy("slug").agg(F.count("*").alias("n")), out, ["slug"], batch_id, _add(batch_id), buckets)

    return _run(once.select("slug"), each, checkpoint, available_now)


def _add(batch_id: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def add(held: DataFrame | None, new: DataFrame) -> DataFrame:
        if held is None:
            return new.select("slug", F.col("n").alias("view_count"), F.lit(batch_id).cast("long").alias("batch"))
        both = held.join(new, "slug", "full")
        fresh = F.col("n").isNotNull() & (F.coalesce("batch", F.lit(-1)) < batch_id)
        return both.select("slug", (F.coalesce("view_count", F.lit(0)) + F.when(fresh, F.col("n")).otherwise(0)).alias("view_count"),
                           F.when(fresh, F.lit(batch_id).cast("long")).otherwise(F.col("batch")).alias("batch"))

    return add


def capture_stream(payloads: DataFrame, out: str, checkpoint: str, available_now: bool = False, buckets: int = 64) -> StreamingQuery:
    """Keep the latest payload per (resource, source_id, variant) in a table at ``out``; only buckets with new rows are written."""
    from tastegraph.sources.payloads import raw_capture

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, out, ["resource", "source_id", "variant"], batch_id,
               lambda held, new: raw_capture(new.limit(0) if held is None else held.select(*new.columns), new), buckets)

    return _run(payloads, each, checkpoint, available_now)


def watch_stream(batchwise: DataFrame, tables: Callable[[int], Tables], out: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Fan a stream of watch events out to states, transitions, viewings and ratings.

    ``tables(batch_id)`` gives the tables as they stood before the batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for name, rows in apply_watch_events(batch, tables(batch_id)).items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/v={batch_id}")

    return _run(batchwise, each, checkpoint, available_now)


def late_rows(events: DataFrame, watermark: str) -> tuple[DataFrame, DataFrame]:
    """Split a bounded replay at a watermark time: rows in time, and late rows for a side table."""
    late = F.col("occurred_at") < F.lit(watermark).cast("timestamp")
    return events.filter(~late), events.filter(late)
