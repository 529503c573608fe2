"""The operators as registered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_drop_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.line_dedup import drop_lines

    return drop_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op6_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tastegraph.llm.alignment import align_documents

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(_table(spark, sf_dir, "documents"), a, b)


def op12_near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.simhash import near_fingerprints

    return near_fingerprints(_table(spark, sf_dir, "documents"))


def op13_mine_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastegraph.llm.negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """Where the public word-end BPE vocabulary lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_drop_recurring_lines, op2_pack_sequences, op3_extract_main_text, op4_scan_secrets, op5_fingerprint_documents, op6_score_toxicity, op7_find_leaks, op8_shard_documents, op9_filter_urls, op10_near_duplicates,
                                     op11_align_tokenizers, op12_near_fingerprints, op13_mine_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    from tastegraph.llm import line_dedup, negatives, sharding, url_filter

    return {"op1_drop_recurring_lines": line_dedup.SQL, "op8_shard_documents": sharding.SQL, "op9_filter_urls": url_filter.SQL,
            "op13_mine_hard_negatives": negatives.SQL}
