"""Load the given tables and the model projected from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastegraph.demo.model import DEPENDS, MODEL, SOURCES
from tastegraph.sources.ontology import load_ontology
from tastegraph.tables import Tables

# tables of the session at hand; another session starts afresh
_LOADED: dict[str, Tables] = {}
_SESSION: list[SparkSession] = []


def model_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All given tables, the projected model and the ontology, planned on first use."""
    if not _SESSION or _SESSION[0] is not spark:
        _LOADED.clear()
        _SESSION[:] = [spark]
    if sf_dir in _LOADED:
        return _LOADED[sf_dir]

    def load(name: str) -> DataFrame:
        if name in SOURCES:
            return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        if name == "predicate_meta":
            return load_ontology(spark)
        if name not in MODEL:
            raise AttributeError(f"no table named {name!r}")
        return spark.sql(MODEL[name], **{d: getattr(tables, d) for d in DEPENDS[name]})

    tables = Tables(loader=load)
    _LOADED[sf_dir] = tables
    return tables
