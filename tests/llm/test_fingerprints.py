import hashlib
import random
from collections import Counter

import numpy as np

from tastegraph.llm.fingerprints import Sampler, fingerprint_documents, likeness


def test_collision_rate_is_generalised_jaccard():
    rng, sampler = random.Random(5), Sampler(512)
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        a = Counter({f"w{i}": rng.randint(1, 9) for i in range(200)})
        b = Counter({w if rng.random() < share else w + "x": n if rng.random() < 0.7 else rng.randint(1, 9) for w, n in a.items()})
        words = set(a) | set(b)
        want = sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words)
        marks = [sampler.fingerprint(" ".join(w for w, n in c.items() for _ in range(n))) for c in (a, b)]
        assert abs(likeness(*marks) - want) < 0.09


def brute(rows):
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(order):
        half = len(t) // 2
        out[(d, t)] = t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]
    return out


def test_edited_texts_and_odd_rows(docs):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("aé😀bc") * rng.randint(1, 5) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(7, None), (10**15, "far away"), (-5, "x"), (None, "no id"), (500, "long " * 30_000)]
    want = brute(rows)
    sampler = Sampler()
    for slices in (4, 1024):
        got = {r["doc_id"]: r for r in fingerprint_documents(docs(*rows, rows[3], rows[3]), slices=slices).collect()}
        assert len(got) == len(rows)
        for (d, t), edited in want.items():
            r = got[d]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            mark = np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint16)
            other = np.frombuffer(bytes.fromhex(r["edited_fingerprint"]), np.uint16)
            assert (mark == sampler.fingerprint(t)).all() and (other == sampler.fingerprint(edited)).all()
            assert r["near_edited"] == likeness(mark, other)
    assert fingerprint_documents(docs(*rows, rows[3], rows[3])).where("doc_id = 9").count() == 3


def test_one_document_and_none(docs):
    (r,) = fingerprint_documents(docs((1, "abcd efgh"))).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() and r["near_next"] == 1.0
    assert fingerprint_documents(docs()).count() == 0
