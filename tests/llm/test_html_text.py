import itertools
import random
import time
import tracemalloc

import numpy as np
import pytest

from tastegraph.llm.dom import blocks
from tastegraph.llm.html_text import Field, expectations, extract_pages, features, main_text, train
from tastegraph.llm.labelled_pages import LAYOUTS, labelled_pages


@pytest.fixture(scope="module")
def field():
    return train(labelled_pages())


def test_held_out_pages(field):
    wrong = total = 0
    for page in labelled_pages(each=8, seed=77):
        found = blocks(page)
        for block, label in zip(found, field.decode(found), strict=True):
            wrong += block.marked != bool(label)
            total += 1
    assert wrong / total < 0.01


def test_an_article_among_the_rest(field):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1>"
        "<p>First\n  text&nbsp;here <b>bold</b>, it is.<br><p>Second &lt;p&gt; it goes on for a while.</p><script>var x='</p>';</script><p>All rights reserved.</p></article>"
        "<aside class=sidebar><p>More to read from us</p></aside><div id=comments><p>I disagree with this text.</p></div><form><label>Name</label></form>"
        "<div class='cookie-notice'>We use cookies.</div><footer>&copy; us</footer></body></html>")
    assert main_text(page, field) == "A & B\nFirst text here bold, it is.\nSecond <p> it goes on for a while.\nAll rights reserved."


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>Part {i} of a very long text goes here.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>> </p> <p"), (4, "u", "<article><p>Cut off text in the arti"), (5, "u", long), (5, "u", long),
            (None, "u", "<article><p>a &am</p><p class=\"x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = [tuple(r) for r in extract_pages(df).collect()]
    assert len(out) == len(rows) and [r for r in out if r[0] in (1, 2)] == [(1, "u", "", 0), (2, None, "", 0)]
    assert [r[2] for r in out if r[0] == 4] == ["Cut off text in the arti"] and [r[2] for r in out if r[0] is None] == ["a &am"]
    assert all(r[2].count("\n") == 19_999 and r[3] == len(r[2]) for r in out if r[0] == 5)
    assert extract_pages(df.limit(0)).count() == 0


def block_f1(field, pages):
    hit = wrong = missed = 0
    for page in pages:
        found = blocks(page, field.weights)
        for block, label in zip(found, field.decode(found), strict=True):
            hit, wrong, missed = hit + (block.marked and label), wrong + (label and not block.marked), missed + (block.marked and not label)
    return 2 * hit / (2 * hit + wrong + missed)


def test_layouts_never_seen(field):
    assert block_f1(field, labelled_pages(each=0, seed=77)) > 0.98  # 300 layouts of another seed
    held = LAYOUTS[2::3]
    other = train(labelled_pages(layouts=tuple(x for x in LAYOUTS if x not in held)))
    assert block_f1(other, labelled_pages(each=8, seed=79, composed=0, layouts=held)) > 0.93


def test_list_items_of_a_page_of_plain_elements(field):
    page = (
        '<div class="wrap"><div class="masthead"><a href=/>Site</a></div><div class="crumbs"><a href=/a>Home</a> <a href=/b>News</a></div><div class="story-area"><h1>The title of it</h1>'
        "<p>The first paragraph goes on for a while, as they do.</p><p>The second one says some more about it all.</p><ul><li>a first point of the list</li><li>a second point</li></ul></div>"
        '<div class="rail"><h3>More</h3><ul><li><a href=/c>Other news of the day</a></li></ul></div><div class="bottom"><p>Copyright us</p></div></div>')
    assert main_text(page, field).split("\n")[3:] == ["a first point of the list", "a second point"]


@pytest.mark.parametrize("page", [
    "<div class=a>x " * 20_000, "".join(f"<div class=c{i}>x " for i in range(20_000)), "<b>" * 20_000 + "<h1>x " * 20_000, "<p>" + "<b>x</i>" * 20_000])
def test_deep_nesting_is_read_in_little_memory(field, page):
    start = time.process_time()
    main_text(page, field)
    assert time.process_time() - start < 5
    tracemalloc.start()
    main_text(page, field)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_viterbi_and_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    lengths, s = [1, 4, 6], rng.normal(size=(2, 2))
    node, real = np.zeros((3, 6, 2)), np.zeros((3, 6))
    chance, steps = np.zeros((3, 6)), np.zeros((2, 2))
    for p, n in enumerate(lengths):
        real[p, :n], node[p, :n, 1] = 1, rng.normal(size=n) * 2
        paths = list(itertools.product((0, 1), repeat=n))
        scores = [sum(node[p, t, y[t]] for t in range(n)) + sum(s[y[t], y[t + 1]] for t in range(n - 1)) for y in paths]
        weights = np.exp(scores) / np.exp(scores).sum()
        for y, w in zip(paths, weights, strict=True):
            chance[p, :n] += w * np.array(y)
            for t in range(n - 1):
                steps[y[t], y[t + 1]] += w
        page = [f"<p class=k{t}>word {t}</p>" for t in range(n)]
        found = blocks("".join(page))
        assert all(f"class:k" in names for names in features(found))
        field = Field({}, s)
        field.weights = Weights(node[p, :n, 1])
        assert tuple(field.decode(found)) == paths[int(np.argmax(scores))]
    main, expected = expectations(node, s, real)
    assert np.allclose(main, chance) and np.allclose(expected, steps)


class Weights(dict):
    """The score of each block in turn, under a name that every block has once."""

    def __init__(self, scores):
        super().__init__()
        self.scores = iter(scores.tolist())

    def get(self, name, default=0.0):
        return next(self.scores) if name == "bias" else default
