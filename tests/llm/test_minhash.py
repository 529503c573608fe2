import random
import re
from collections import Counter, defaultdict

from tastegraph.llm import minhash
from tastegraph.llm.minhash import deduplicate, near_duplicates


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    posted, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            posted[x].append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in posted[x] if e < d).items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_components_equal_brute_force(docs):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmno") + str(rng.randint(0, 40))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randint(6, 160))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 3 + group, " ".join(own)))
    # a chain whose ends are unlike, very short texts, copies in another case
    chain = [f"c{i}" for i in range(120)]
    rows += [(1000 + k, " ".join(chain[k * 8 :] + [f"d{i}" for i in range(k * 8)])) for k in range(5)]
    rows += [(2000, "a b c d"), (2001, "A b\tc  D"), (2002, "a b c"), (2003, ""), (2004, None), (2005, " \n"), (2006, "a b c d e"), (2007, "a b c d e f")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs(*rows)).collect()}
    assert got == brute(rows)


def test_crowds_in_chunks_tie_what_all_pairs_tie(spark, monkeypatch):
    rng = random.Random(12)
    base = [[rng.randint(-9, 9) for _ in range(64)] for _ in range(6)]
    rows = []
    for i in range(150):
        own = list(rng.choice(base))
        for k in rng.sample(range(64), rng.randint(0, 45)):
            own[k] = rng.randint(100, 10**6)
        rows.append((i * 2, own))
    sets = spark.createDataFrame(rows, "node long, signature array<int>")

    def groups(pairs):
        parent = {n: n for n, _ in rows}

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for a, b in pairs:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        return {n: root(n) for n in parent}

    agree = [(a, b) for k, (a, s) in enumerate(rows) for b, t in rows[:k] if sum(x == y for x, y in zip(s, t)) >= 30]
    for crowd in (5, 1024):
        monkeypatch.setattr(minhash, "CROWD", crowd)
        found = [tuple(r) for r in minhash.ties(sets, minhash.postings(sets, 30), 30).collect()]
        assert groups(found) == groups(agree) and len(set(groups(agree).values())) > 6
        assert len(set(found)) < len(agree)


def test_rows_of_one_doc_id_with_several_texts_give_the_same_each_time(docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, b)]
    once = sorted(tuple(r) for r in near_duplicates(docs(*rows)).collect())
    again = sorted(tuple(r) for r in near_duplicates(docs(*rows[::-1]).repartition(3)).collect())
    assert once == again and {r[2] for r in once if r[0] in (5, 9)} == {5}


def test_repeated_and_nameless_rows(docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (7, text), (9, "long " + "x y z " * 30_000)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs(*rows)).collect()), key=repr)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (None, None, True)]
    kept = deduplicate(docs(*rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [5, 5, 9, None]
    assert kept.columns == docs(*rows).columns


def test_empty_table(docs):
    assert near_duplicates(docs()).count() == 0
