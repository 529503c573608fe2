import random
import zlib

import numpy as np

from tastegraph.llm.toxicity import WordScores, drop_toxic, score_documents, score_texts, train

CLEAN = [a + b for a in "ba co de fi gu la me no".split() for b in "ter zen lin mor sat pul".split()]
BAD = ["idiotic", "moronic", "stupids"]


def corpus(n, seed, bad=BAD):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, labels


def test_held_out_and_misspelt_words():
    model = train(*corpus(400, 1))
    for bad in (BAD, ["idiottic", "moronics", "stupidss"]):
        texts, labels = corpus(200, 2, bad)
        said = score_texts(texts, WordScores(model.rows()), model.offset())
        right = ((said >= 0.5) == np.array(labels)).mean()
        assert right > 0.95, (bad, right)


def test_one_class_or_no_labels():
    for texts, labels in (([], []), (["a b"], [0]), (["a b", None], [1, 1])):
        said = score_texts(["a b", "", None], WordScores(train(texts, labels).rows()), train(texts, labels).offset())
        assert len(set(said.tolist())) == 1 and (said[0] > 0.5) == bool(labels and labels[0])


def test_query_and_stage(spark, docs):
    texts, labels = corpus(300, 3)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, "idiotic moronic stupids"), (902, "bater " * 50_000), (5, texts[5])]
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 0, 1), (7777, 0, 1), (900, None, None), (3, 0, 9)], "doc_id long, quality int, toxic int")
    out = score_documents(docs(*rows), marks).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    kept = drop_toxic(docs(*rows), marks)
    assert kept.columns == docs(*rows).columns
    assert kept.count() == sum(not r["predicted"] for r in out)
    assert score_documents(docs(), marks).count() == 0 and drop_toxic(docs(*rows[:3]), marks.limit(0)).count() == 3


class Fixed(dict):
    def learn(self, words):
        self.update({w: 1.0 if w == b"bad" else -0.5 for x in words for w in x})


def test_scores_do_not_depend_on_where_a_phrase_lies():
    texts = [" ".join(["ok"] * at + ["bad"] * 8 + ["ok"] * (60 - at)) for at in range(8, 53)]
    assert len(set(score_texts(texts, Fixed(), 0.0).round(9).tolist())) == 1
    assert score_texts([" ".join(["ok"] * 16 + ["bad"])], Fixed(), 0.0)[0] < 0.5  # the last word is not judged alone


def test_rare_toxic_words_have_weight():
    texts, labels = corpus(400, 5)
    toxic = [i for i, y in enumerate(labels) if y][:4]
    for i in toxic:
        texts[i] = " ".join("vulgrukh" if w in BAD else w for w in texts[i].split())
    known = WordScores(train(texts, labels).rows())
    known.learn([[b"vulgrukh", b"vulgrukhs"]])
    assert known[b"vulgrukh"] > 1 and known[b"vulgrukhs"] > 1
