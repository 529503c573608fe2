import pytest

from tastegraph.llm.url_filter import LIMIT, WEIGHTS, automaton, hits, judge_urls, load_weights

CASES = {
    "https://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://a.example.net/fr/1?x#y": ("a.example.net", "/fr/1", "net/", "block"),
    "HTTP://WWW.Example.COM/de/": ("www.example.com", "/de/", "example.com/de/", "block"),
    "http://example.com/DE/": ("example.com", "/DE/", None, "allow"),
    "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
    "http://x.org/fr/porn": ("x.org", "/fr/porn", "org/fr/", "allow"),
    "http://porn.com/": ("porn.com", "/", None, "block"),
    "http://pornography-museum.com/": ("pornography-museum.com", "/", None, "allow"),
    "http://x.com/free-bets": ("x.com", "/free-bets", None, "block"),
    "http://x.com/free/free": ("x.com", "/free/free", None, "allow"),
    "http://x.com?adult=1": ("x.com", "", None, "allow"),
    "http://a.net": ("a.net", "", None, "allow"),
    "a.net/en/": ("", "", None, "allow"),
    "http://u.com/a://b.net/": ("u.com", "/a://b.net/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://x.com/" + "a/" * 50_000 + "xxx": ("x.com", "/" + "a/" * 50_000 + "xxx", None, "block"),
}


def test_rules_and_vocabulary(spark):
    urls = list(CASES)
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r", "v")], "page_id long, url string, host string, rule string, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df).collect()]
    assert {g[0]: g[1:] for g in got} == {i: CASES[u] for i, u in enumerate(urls)}
    assert len(got) == len(urls) + 1
    assert judge_urls(df.limit(0)).count() == 0


def test_boundaries():
    terms = automaton(("abc",), ("abcd", "d"))
    assert hits("xabc abc1 abc", terms) == ({"abc"}, set())
    assert hits("abcd.d", terms) == (set(), {"abcd", "d"})
    assert hits("éabcé", terms) == ({"abc"}, set())
    assert hits("abc", automaton((), ())) == (set(), set())


HARMLESS = """/free-shipping/track-order /hot/win-a-trip /loan/free-quote /adult-education/courses /sex-education /middlesex/council /essex/news /blog/free-software /ads.txt
/click-and-collect /banner/history /crypto/lecture-notes /credit-union /library/loans /bonus-track/album /slots-of-time /poker-face-lyrics /winners/2020 /betting-on-science
/analysis/dating-of-rocks /carbon-dating /hot-springs /free /win /torrents-of-rain /crack-propagation /serial-port /proxy-server/manual /naked-eye-astronomy /nude-mice
/casinos-history /lottery-results /cheap-flights /pills-history /pharmacy/opening-hours /replica-of-the-ship /promo?ref=1&click=2 /tracking?ad=1 /deals/discount /earn-a-degree
/girls-football /steroids-biosynthesis /singles/1969 /webcam/harbour /bitcoin/paper /prize/physics /popup-museum /spam-recipes /weightloss-study /escorted-tours""".split()


def test_harmless_urls_stay(spark):
    assert len(HARMLESS) == 50
    df = spark.createDataFrame([(i, f"http://site{i}.com{path}") for i, path in enumerate(HARMLESS)], "page_id long, url string")
    assert [r["url"] for r in judge_urls(df).where("verdict = 'block'").collect()] == []


@pytest.mark.parametrize("url, terms, weight, verdict", [
    ("http://x.com/casino-bonus", ["bonus", "casino"], 10, "block"), ("http://x.com/bonus/casino?casino", ["bonus", "casino"], 10, "block"),
    ("http://hot-girls.com/free", ["free", "girls", "hot"], 10, "block"), ("http://x.com/hot/girls", ["girls", "hot"], 6, "allow"),
    ("http://x.com/track/click/banner/ads", ["ads", "banner", "click", "track"], 4, "allow"), ("http://x.com/VIAGRA", ["viagra"], 10, "block")])
def test_weights_add_up_over_distinct_terms(spark, url, terms, weight, verdict):
    (r,) = judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()
    assert (sorted(r["strict_terms"] + r["soft_terms"]), r["weight"], r["verdict"]) == (terms, weight, verdict)


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Wombat", 7), ("wombat", 4), ("stew", 3), (None, 9), ("", 9), ("none", 0)], "term string, weight int")
    assert load_weights(terms) == {"wombat": 7, "stew": 3}
    df = spark.createDataFrame([(1, "http://x.com/wombat"), (2, "http://x.com/wombat-stew"), (3, "http://x.com/porn")], "page_id long, url string")
    assert [r["verdict"] for r in judge_urls(df, weights=load_weights(terms)).orderBy("page_id").collect()] == ["allow", "block", "allow"]
    assert max(WEIGHTS.values()) == LIMIT
