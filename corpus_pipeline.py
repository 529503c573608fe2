"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and packing, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.llm.decontaminate import drop_leaks
from tastegraph.llm.line_dedup import drop_lines
from tastegraph.llm.minhash import deduplicate
from tastegraph.llm.packing import pack_documents
from tastegraph.llm.queries import tokenizer_path
from tastegraph.llm.storage import written
from tastegraph.llm.toxicity import drop_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A NULL or empty text scores as clean, a very long one by its worst window; repeated rows score alike."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each; every document stays, ``n_chars`` follows its text.

    A NULL text stays NULL; repeated rows count as one document and change alike; other columns stay as they are.
    """
    kept = drop_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Documents without words, NULL ones too, and rows without doc_id are like no other and stay, as do repeated rows of a doc_id that stays.
    """
    return deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those without text and rows without doc_id stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, in sequences; a NULL or empty text is its end token alone."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", clean), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs)
    return docs
