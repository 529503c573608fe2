"""Cutting lineage where a job iterates, in a folder every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which all executors share.

    A folder of our own is used only by a session inside one JVM that names none; elsewhere its absence is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if context.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(shared)
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the frame to the session's checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: compressed, and of a size Catalyst knows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
