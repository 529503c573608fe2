"""MinHash near-duplicates by an inverted join over signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.components import components
from tastegraph.llm.spread import join_counted
from tastegraph.llm.storage import written
from tastegraph.llm.words import WordHash, mix, pieces, shingles, split_words
from tastegraph.plans.lineage import checkpoint

#: Words of a shingle, coordinates of a signature, coordinates a candidate pair must agree in, likeness in hundredths.
#: A pair of likeness 0.75 agrees in 48 of 64 on average; the chance of fewer than 30 is 0.4 in a million.
WIDTH, COORDINATES, MATCHES, PERCENT = 5, 64, 30, 75
SEED = 20_240_607
#: Shingles of a chunk whose sets one task compares with another chunk's, and what each set counts beside its own.
CHUNK, LEAST_WEIGHT = 250_000, 250
#: Signatures of a chunk of a crowd; two chunks meet in one task.
CROWD = 1024


def _multipliers(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(2 * coordinates, dtype=np.uint64) + np.uint64(SEED)
    bits = mix(n * np.uint64(0x9E3779B97F4A7C15))
    return bits[:coordinates] | np.uint64(1), bits[coordinates:]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """Least value of every hash function over a set, as unsigned 32-bit numbers."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), block):
        np.minimum(least, (hashes[None, at : at + block] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sign(documents: DataFrame, width: int = WIDTH, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, t, n_shingles, set_a, set_b, signature) of every document; t names its text, set_a and set_b are 128 bits that name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = WordHash(), _multipliers(coordinates)
        for rows in pieces(batches):
            sizes, names_a, names_b, signed = [], [], [], []
            for text in rows["text"]:
                s = shingles(split_words(text), known, width)
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    names_a.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    names_b.append(int(mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    signed.append(signature(s, a, b).view(np.int32) if len(s) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["t"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(names_a, pa.int64()),
                 pa.array(names_b, pa.int64()), pa.array(signed, pa.list_(pa.int32()))],
                ["doc_id", "t", "n_shingles", "set_a", "set_b", "signature"])

    return _texts(documents).mapInArrow(run, "doc_id long, t long, n_shingles long, set_a long, set_b long, signature array<int>")


def _texts(documents: DataFrame) -> DataFrame:
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.select("doc_id", F.xxhash64("text").alias("t"), "text")


def postings(sets: DataFrame, matches: int) -> DataFrame:
    """(token, node): every node under those of its coordinate-value pairs that a merge has to look at.

    A pair agreeing in ``matches`` coordinates shares one of the first n - matches + 1 of the n coordinate-value pairs of either
    side, rarest first. Pairs only one node has come first of all and lead nowhere, so they are only counted.
    """
    all_ = sets.select("node", F.posexplode("signature").alias("at", "value")).select(
        "node", F.expr("shiftleft(bigint(at), 32) | (bigint(value) & 4294967295L)").alias("token"))
    shared = all_.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    listed = all_.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("l"))
    return listed.where(F.size("l") >= matches).select(
        F.explode(F.expr(f"slice(l, 1, size(l) - {matches - 1})")).alias("p"), "node").select("p.token", "node")


def ties(sets: DataFrame, posted: DataFrame, matches: int) -> DataFrame:
    """(a, b): ties that span what agrees in ``matches`` coordinates or more among the nodes posted under each coordinate-value pair.

    The nodes under one coordinate-value pair are a crowd. Of crowds with the same members one is looked at; a large one is cut into chunks and every
    two chunks meet in one task, which counts the coordinates that each two signatures share and returns one tie a node, not all pairs.
    """
    crowds = posted.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")).where("n > 1")
    crowds = crowds.groupBy("n", "s", "x").agg(F.min("token").alias("token")).select("token", "n")
    cut = join_counted(posted, crowds, ["token"], "n").withColumn("chunks", F.expr(f"(n + {CROWD - 1}) div {CROWD}")).withColumn(
        "chunk", F.expr("pmod(xxhash64(node), chunks)"))
    others = F.expr("IF(chunks = 1, array(0L), filter(sequence(0L, chunks - 1), c -> c <> chunk))")
    dealt = cut.withColumn("with", F.explode(others)).select("token", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "node")
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = dealt.join(sets.select("node", "signature"), "node")
    ordered = signed.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, signatures = None, [], []

        def tied() -> list[tuple[int, int]]:
            first = led(agreeing(np.array(signatures, np.int32), matches)).tolist() if len(nodes) > 1 else []
            return [(nodes[x], node) for x, node in zip(first, nodes) if nodes[x] != node]

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for rows in pieces(batches, 4096):
            out = []
            for token, i, j, node, signature_ in zip(rows["token"], rows["i"], rows["j"], rows["node"], rows["signature"], strict=True):
                if key != (token, i, j):
                    out += tied()
                    key, nodes, signatures = (token, i, j), [], []
                nodes.append(node)
                signatures.append(signature_)
            yield batch(out)
        yield batch(tied())

    return ordered.mapInArrow(run, "a long, b long")


def agreeing(signatures: np.ndarray, matches: int) -> np.ndarray:
    """Which two signatures agree in ``matches`` coordinates or more."""
    n = len(signatures)
    shared = np.zeros((n, n), np.uint8)
    for column in signatures.T if n > 64 else []:
        shared += column[:, None] == column[None, :]
    if n <= 64:
        shared = (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2)
    near = shared >= matches
    np.fill_diagonal(near, False)
    return near


def led(near: np.ndarray) -> np.ndarray:
    """For each member the first that it reaches over pairs."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(sets: list[np.ndarray], percent: int, often: int = 64, columns: int = 1024) -> np.ndarray:
    """For each set the first of those it reaches over links, where 100 * intersection >= percent * union.

    Intersections of all sets are counted at once: shingles that many sets have as columns of a matrix product,
    the others by the pairs of sets that share them.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    names, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    both = np.zeros((n, n), np.float32)
    frequent = np.flatnonzero(many > often)
    place = np.full(len(names), -1)
    place[frequent] = np.arange(len(frequent))
    for c in range(0, len(frequent), columns):
        here = (place[at] >= c) & (place[at] < c + columns)
        held = np.zeros((n, min(columns, len(frequent) - c)), np.float32)
        held[owner[here], place[at[here]] - c] = 1
        both += held @ held.T
    order = np.argsort(at, kind="stable")
    for k in np.unique(many[(many > 1) & (many <= often)]):
        rows = owner[order[many[at[order]] == k]].reshape(-1, k)
        for x in range(k - 1):
            for y in range(x + 1, k):
                np.add.at(both, (rows[:, x], rows[:, y]), 1)
    both = np.maximum(both, both.T)
    near = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    np.fill_diagonal(near, False)
    return led(near)


def confirm(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that span what full shingle sets connect among the members (part, node, weight, text) of each part.

    A part is cut into chunks of bounded weight and every two chunks meet once, so a large part is spread over many
    tasks and each holds two chunks at most. A task counts all intersections and returns one link a text, not all pairs.
    """
    totals = members.groupBy("part").agg(F.ceil(F.sum("weight") / CHUNK).alias("chunks"))
    cut = members.join(totals, "part").withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))
    dealt = cut.withColumn("with", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(
        "part", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "node", "text")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "part", "i", "j").sortWithinPartitions("part", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, nodes, sets = WordHash(), None, [], []

        def links() -> list[tuple[int, int]]:
            return [(nodes[x], node) for x, node in zip(linked(sets, percent).tolist(), nodes, strict=True) if nodes[x] != node] if len(sets) > 1 else []

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for rows in pieces(batches):
            out = []
            for part, i, j, node, text in zip(rows["part"], rows["i"], rows["j"], rows["node"], rows["text"], strict=True):
                if key != (part, i, j):
                    out += links()
                    key, nodes, sets = (part, i, j), [], []
                nodes.append(node)
                sets.append(shingles(split_words(text), known, width))
            yield batch(out)
        yield batch(links())

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = WIDTH, coordinates: int = COORDINATES, matches: int = MATCHES,
                    percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id it reaches over links) and kept.

    Documents link where 100 * intersection >= percent * union of their sets of ``width``-word shingles; candidates agree in
    ``matches`` coordinates of their signatures. Equal sets form one class first, so exact copies are never compared.
    Classes are posted under their rarest coordinate-value pairs; among those under one pair the coordinates that signatures share are counted,
    and ``matches`` or more tie two classes. Tied classes form a part, and all full sets of a part are compared in blocks. No pair is ever a row.

    Texts without words have no shingles and link with nothing. Rows of one doc_id count as one document, by its set if they have one text, else
    by that of the text whose hash is smallest among those it stands for. A row without doc_id links with nothing: component NULL, kept.
    Repeated rows each stay. Texts of any length are read whole; other columns are ignored; an empty table gives none.
    """
    signed = checkpoint(sign(documents, width, coordinates))
    classes = checkpoint(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min(F.struct("doc_id", "t")).alias("named"), F.first("signature").alias("signature"), F.count("*").alias("n"))  # one set has one signature
        .select("set_a", "set_b", "n_shingles", "n", F.col("named.doc_id").alias("node"), F.col("named.t").alias("t"), "signature"))
    sets = checkpoint(classes.groupBy("node").agg(F.min_by(F.struct("t", "signature", "n_shingles"), F.struct("t", "set_a", "set_b")).alias("c")).select("node", "c.*"))
    posted = checkpoint(postings(sets, matches))
    parts = components(ties(sets, posted, matches), "a", "b")
    parts = parts.union(parts.select(F.col("component").alias("node"), "component").distinct())
    chosen = parts.join(sets.select("node", "t", (F.col("n_shingles") + LEAST_WEIGHT).alias("weight")), "node")
    texts = _texts(documents).withColumnRenamed("doc_id", "node")
    members = written(
        chosen.join(texts, ["node", "t"]).select(F.col("component").alias("part"), "node", "weight", "text").dropDuplicates(["node"]))
    groups = components(confirm(members, width, percent), "a", "b")
    named = classes.join(groups, "node", "left").select(
        "set_a", "set_b", "n_shingles", "n", F.coalesce("component", "node").alias("found"))
    # a set that many documents have meets them where they lie
    linked_ = join_counted(signed.where("n_shingles > 0 and doc_id is not null"), named, ["set_a", "set_b", "n_shingles"], "n")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_.select("doc_id", "n_shingles", F.col("found").alias("component_id")).unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, **how: int) -> DataFrame:
    """The documents kept: of each group the one with the smallest doc_id, with all columns."""
    gone = near_duplicates(documents, **how).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, documents["doc_id"].cast("long") == F.col("__gone"), "left_anti")
