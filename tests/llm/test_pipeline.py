import random

import duckdb
import pytest

import corpus_pipeline
from test_minhash import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, a recurring line, near copies, and benchmark items."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(9)) + ".") for i in range(10)]
    rows, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randint(30, 90))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(("zzidiot", "zzmoron")))
        text = " ".join(words)
        if i % 7 == 1:
            text += "\nthis line is in very many documents"
        if i % 20 == 3:
            text += "\n" + items[i % 10][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 3:
            labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[4 + 5 * i][1] + " more", "en", "s", 9) for i in range(8)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_stages_in_order_against_brute_force(spark, folder, tmp_path):
    path, rows, items = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = {r[0]: r[1] for r in rows}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(seen)
            assert {r["length"] for r in docs.where("doc_id in (300, 301)").collect()} == {1}
            continue
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            want = {d for d, t in seen.items() if "zz" not in (t or "")}
            assert len(set(now) ^ want) <= 2
        elif name == "line_dedup":
            con = duckdb.connect()
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?)", list(seen.items()))
            from tastegraph.llm.line_dedup import SQL
            assert now == {r[0]: r[3] for r in con.execute(SQL).fetchall()} and now != seen
        elif name == "near_dedup":
            assert set(now) == {d for d, (_, _, kept) in brute(list(seen.items())).items() if kept} and len(now) < len(seen)
        else:
            held = {d for d, t in seen.items() if any(item in (t or "") for _, item in items)}
            assert set(now) == set(seen) - held and held
        seen = now


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50
