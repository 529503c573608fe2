"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.plans.slices import with_rank

#: Slices a stratum is ranked in; about one per million rows of the largest stratum keeps a task's sort small.
SLICES = 1024


def _fraction(hexed: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def interleave(rows: DataFrame, key: str, stratum: str, shards: int, seed: int, slices: int = SLICES) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0) so that every shard matches the mixture of strata.

    Rows of a stratum are shuffled by a seeded digest of ``key`` and ranked; row r of n gets the fractional rank
    (r - u) / n, where u in [0, 1) is a seeded offset of the stratum, so small strata don't all fall on the same place.
    All rows in the order of fractional rank are cut into shards whose counts differ by one at most.

    Both ranks are taken inside slices of the digest or of the fractional rank, with one count per slice carried over,
    so a stratum with a third of all rows is spread over all tasks. NULL strata form one stratum, a NULL key is a key like any
    other, repeated rows are told apart only by their place, and an empty table gives no rows. Other columns stay.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    dealt = rows.withColumns({
        "__stratum": named,
        "__digest": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")),
    })
    ranked = with_rank(
        dealt, ["__stratum"], F.floor(_fraction(F.col("__digest")) * slices), [F.col("__digest"), F.col(key)], "__rank")
    sizes = dealt.groupBy("__stratum").agg(F.count("*").alias("__n"))
    offset = _fraction(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__stratum")).cast("binary")))
    placed = ranked.join(sizes, "__stratum").withColumn("__place", (F.col("__rank") - offset) / F.col("__n"))
    cell = F.floor(F.col("__place") * slices)
    ordered = with_rank(
        placed.withColumn("__all", F.lit(0)), ["__all"], cell, [F.col("__place"), F.col("__stratum"), F.col("__digest"), F.col(key)],
        "__position")
    total = dealt.agg(F.count("*").alias("__total")).withColumn("__all", F.lit(0))  # one row
    # the first position of shard s is ceil(s * total / shards)
    return (
        ordered.join(F.broadcast(total), "__all")
        .withColumn("shard", F.expr(f"int(((__position - 1) * {shards}) div __total)"))
        .withColumn("slot", F.expr(f"(__position - 1) - ((bigint(shard) * __total + {shards - 1}) div {shards})"))
        .drop("__stratum", "__digest", "__rank", "__n", "__place", "__all", "__position", "__total"))


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 42, slices: int = SLICES) -> DataFrame:
    """Every document's shard under the law of near-equal row counts, stratified by source.

    Only numbers travel: the text's size and checksum are taken at the scan. A NULL text has size 1 and the checksum of
    no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(rows, "doc_id", "source", shards, seed, slices).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def _crc_steps() -> list[int]:
    """What a byte shifted out of a CRC-32 leaves in it."""
    steps = []
    for crc in range(256):
        for _ in range(8):
            crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
        steps.append(crc)
    return steps


#: The same in SQL with 16 shards and seed 42; the checksum is computed a byte at a time.
SQL = f"""
WITH bytes AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, source, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
         lambda crc, byte: xor(crc >> 8, {_crc_steps()}[(xor(crc, byte) & 255) + 1]))) AS text_crc32 FROM bytes),
dealt AS (
  SELECT *, coalesce('=' || source, 'null') AS stratum, md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM summed),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id) - ('0x' || substr(md5('42:' || stratum), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
            / count(*) OVER (PARTITION BY stratum) AS place FROM dealt),
ordered AS (SELECT *, row_number() OVER (ORDER BY place, stratum, digest, doc_id) - 1 AS pos, count(*) OVER () AS total FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 16 // total)::INTEGER AS shard,
       (pos - ((pos * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM ordered
"""
