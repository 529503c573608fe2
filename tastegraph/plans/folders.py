"""Folders of tables, on whatever file system Spark reads them from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if there is no such folder."""
    system, where = files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()] if system.exists(where) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    system, where = files(spark, path)
    system.delete(where, True)
