"""Queries by name, each a DataFrame job beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastegraph.demo.load import model_tables
from tastegraph.demo.oracle_views import compose
from tastegraph.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL where there is one."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query as ``fn(spark, sf_dir) -> DataFrame``."""
    from tastegraph.demo import catalog  # noqa: F401

    def runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(model_tables(spark, sf_dir))

    return {name: runner(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of every query that has one, runnable on the given tables."""
    from tastegraph.demo import catalog  # noqa: F401

    return {name: compose(sql) for name, sql in _SQL.items()}
