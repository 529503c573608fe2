from collections import Counter, defaultdict
import zlib

from tastegraph.llm.sharding import shard_documents


def test_shards_are_even_and_match_the_mixture(docs):
    rows = [(i, "x" * (i % 7), "big" if i % 3 == 0 else f"s{i % 11}") for i in range(2000)] + [(5000 + i, "y", f"only{i}") for i in range(200)]
    found = shard_documents(docs(*rows), slices=16).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    counts = Counter(r["shard"] for r in found)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots, mixture, single = defaultdict(list), defaultdict(Counter), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        mixture[r["source"]][r["shard"]] += 1
        single[r["shard"]] += r["source"].startswith("only")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for source, own in mixture.items():
        n = sum(own.values())
        # where the 200 sources of one row fall moves the cuts by a few rows
        assert all(abs(own[k] - n / 16) <= 2 + 0.08 * n / 16 for k in range(16)), source
    assert max(single.values()) <= 200 / 16 * 2.5  # sources of one row don't meet in one shard


def test_digests_and_odd_rows(spark, docs):
    rows = [(1, None, None), (2, ""), (None, "é"), (3, "a"), (3, "a"), (4, "b" * 100_000)]
    got = {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in shard_documents(docs(*rows)).collect()}
    assert got == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t, *_ in rows}
    assert sorted(r["shard"] for r in shard_documents(docs(*rows)).collect()) == [0, 2, 5, 8, 10, 13]
    assert shard_documents(docs()).count() == 0


def test_order_of_rows_does_not_matter(docs):
    rows = [(i, "t", f"s{i % 3}") for i in range(300)]
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_documents(docs(*rows)).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_documents(docs(*rows[::-1]).repartition(7)).collect()}
    assert a == b
