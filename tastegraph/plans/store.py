"""A keyed Parquet table kept up to date batch by batch, rewriting only what a batch touches.

Rows lie in hash buckets, each bucket in a folder of the batch that last wrote it: ``<path>/v=<batch>/bucket=<n>``. The newest folder of a
bucket holds its rows. A batch reads the newest folders before it of the buckets it has rows for and writes its own, so a batch run
again does the same once more, and a batch broken off has changed nothing that another reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.plans.folders import drop_folder, files, folders


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """For each bucket the batch whose folder holds its rows, of batches that were finished."""
    newest: dict[int, int] = {}
    system, where = files(spark, path)
    for v in sorted(int(name[2:]) for name in folders(spark, path) if name.startswith("v=")):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/_SUCCESS")
        if (before is None or v < before) and system.exists(done):
            newest |= {int(name[7:]): v for name in folders(spark, f"{path}/v={v}") if name.startswith("bucket=")}
    return newest


def current(spark: SparkSession, path: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The table's rows, of some buckets or as they stood before a batch; None if nothing was written."""
    chosen = [f"{path}/v={v}/bucket={b}" for b, v in sorted(_newest(spark, path, before).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*chosen) if chosen else None


def upsert(rows: DataFrame, path: str, keys: list[str], batch_id: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int) -> None:
    """Merge a batch into the table: ``merge(held, rows)`` gives the new rows of the buckets that the batch has keys in.

    The list of touched buckets comes to the driver, ``buckets`` numbers at most. Folders that two later batches have replaced are deleted.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = rows.persist()
    touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]
    if touched:
        merged = merge(current(spark, path, touched, batch_id), rows).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
        _forget(spark, path, batch_id)
    rows.unpersist()


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete bucket folders that neither the newest state nor the one before this batch uses."""
    used = set(_newest(spark, path).items()) | set(_newest(spark, path, batch_id).items())
    for name in folders(spark, path):
        if name.startswith("v=") and int(name[2:]) < batch_id:
            for b in folders(spark, f"{path}/{name}"):
                if b.startswith("bucket=") and (int(b[7:]), int(name[2:])) not in used:
                    drop_folder(spark, f"{path}/{name}/{b}")
