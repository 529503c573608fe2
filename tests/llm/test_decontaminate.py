import random

from tastegraph.llm import decontaminate
from tastegraph.llm.decontaminate import build, drop_leaks, find_leaks, passages, retrieve

COMMON = "the of and to in is that for on with".split()


def words(rng, n):
    return [rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def sentence(rng, n):
    return " ".join(words(rng, n)).capitalize() + "."


def planted(seed=4):
    rng = random.Random(seed)
    items = [(i, " ".join(sentence(rng, rng.randint(6, 30)) for _ in range(rng.randint(1, 4)))) for i in range(90)]
    rows, held = [], set()
    for d in range(150):
        text = words(rng, rng.randint(0, 400))
        if d % 3 == 0:
            item, passage = items[rng.randrange(len(items))]
            at = rng.randint(0, len(text))
            text = [*text[:at], *(passage.upper() if d % 2 else passage).split(), *text[at:]]
            held.add((d, item))
        rows.append((d, " ".join(text)))
    return items, rows, held


def test_planted_items_are_found_and_no_others(spark, docs):
    items, rows, held = planted()
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    whole = sum(len(t) for _, t in items)
    found = [sorted(tuple(r) for r in find_leaks(docs(*rows), benchmark, -(-whole // blocks)).collect()) for blocks in (1, 2, 7)]
    assert {r[:2] for r in found[0]} == held and found[0] == found[1] == found[2]  # scores and all
    kept = drop_leaks(docs(*rows), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in held} and kept.columns == docs().columns


def test_bounds_lose_nothing():
    """Every item at or above the threshold is retrieved: the same scores without an index."""
    import numpy as np

    items, rows, _ = planted(9)
    index = build(items, 0.3)
    ids = [np.array([index.term_ids.get(t, -1) for t in t.lower().split() for t in [t.strip(".").encode()]], np.int64) for _, t in rows]
    _, _, grid = passages(ids)
    got = {(p, item, round(s, 6)) for p, item, s in retrieve(grid, index)}
    want = set()
    for p, row in enumerate(grid):
        terms = set(row[row >= 0].tolist())
        for block, owners in zip(index.impacts, index.owners, strict=True):
            for k, item in enumerate(owners):
                s = sum(block[t][k] for t in terms if t in block)
                if s >= 1 + 1e-9:
                    want.add((p, item, round(float(s), 6)))
    assert want <= got and len(want) > 50


def test_half_an_item_is_no_leak(spark, docs):
    rng = random.Random(8)
    question, answer = sentence(rng, 20), sentence(rng, 12)
    benchmark = spark.createDataFrame([(1, f"{question} {answer}")], "item_id long, text string")
    rows = [(1, f"{sentence(rng, 40)} {question} {sentence(rng, 40)}"), (2, f"{answer} {sentence(rng, 30)}"), (3, f"x {question} {answer} y")]
    assert [r["doc_id"] for r in find_leaks(docs(*rows), benchmark).collect()] == [3]


def test_odd_rows(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu nu xi."
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "rho sigma tau upsilon phi chi psi. omega a b c d e f."), (4, "one"), (5, "...")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "x " * 60_000 + item), (5, "rho sigma tau upsilon phi chi psi. omega a b c d e f."), (6, "number one here")]
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(*rows), benchmark).collect()}
    assert found == {(3, 1), (None, 1), (4, 1), (5, None)}
    assert find_leaks(docs(), benchmark).count() == 0 and find_leaks(docs(*rows), benchmark.limit(0)).count() == 0
    assert sorted((r["doc_id"] for r in drop_leaks(docs(*rows), benchmark).collect()), key=repr) == [1, 2, 6, None]


def test_glued_signs_and_one_changed_word(spark, docs):
    rng = random.Random(11)
    items, rows, held = [], [], set()
    for i in range(60):
        question, answer = words(rng, 24), words(rng, 3 + i % 14)
        if i % 3 == 2:
            question, answer = answer, question  # the short half comes first
        items.append((i, f"{' '.join(question)}? {' '.join(answer)}."))
        short = min(question, answer, key=len)
        if i % 2:
            short[rng.randrange(len(short))] = "zzz"
        short[-1] = f"%{short[-1]}#$&"
        rows.append((i, " ".join([*words(rng, 40), *question, *answer, *words(rng, 40)])))
        held.add((i, i))
    rows += [(100 + i, f"{' '.join(words(rng, 30))} {t.split('? ')[i % 3 == 2]} {' '.join(words(rng, 30))}") for i, t in items]  # the long half alone
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert held <= found and found <= held


def test_very_short_items(spark, docs):
    items = [(1, "Paris"), (2, "New York"), (3, "the red barn"), (4, "who wrote it? Smith.")]
    rows = [(1, "we went to Paris and New York"), (2, "in the red barn again"), (3, "the barn is red"), (4, "Who wrote it? Smith"), (5, "who wrote it, then")]
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(2, 3), (4, 4)}
