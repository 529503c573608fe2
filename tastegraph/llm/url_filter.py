"""URL filter: host and path rules before a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a rule is a host, with its subdomains, and the start of a path. Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Weights of terms; fixed values. What weighs ``LIMIT`` is strict: one rejects a url. The others are soft: distinct ones add up.
LIMIT = 10
_WEIGHED = {
    10: "porn porno pornos pornstar pornstars xxx xvideos hentai camgirl camgirls sexcam sexcams livesex escort escorts milf milfs upskirt cumshot gangbang bestiality "
        "bukkake malware phishing ransomware warez keygen keygens botnet carding viagra cialis levitra xanax tramadol",
    6: "adult sex sexy nude nudes naked erotic erotica fetish nsfw hookup hookups casino casinos bets betting poker roulette blackjack slots jackpot gambling sportsbook "
       "pills pharmacy steroids torrent torrents cracked serials nulled replica replicas payday forex airdrop spyware adware",
    4: "free win winner winners bonus bet odds spins lottery prize cheap pill meds dating singles webcam loan loans credit crypto bitcoin crack serial proxy unblocked spam popup "
       "popups giveaway clickbait miracle detox",
    3: "hot girls babes deals discount rx weightloss profit rich earn instant guaranteed",
    1: "ads ad track tracker tracking click clicks banner banners redirect affiliate ref promo",
}
WEIGHTS = {term: weight for weight, terms in _WEIGHED.items() for term in terms.split()}
#: Terms that a vocabulary may hold; it goes to every task whole.
MOST_TERMS = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty where it is NULL or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lowered, path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); NULL if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    found = None
    for rule, verdict in longest_first:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        said = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, said) if found is None else found.when(fits, said)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def load_weights(terms: DataFrame) -> dict[str, int]:
    """A vocabulary of (term, weight) rows, the largest weight of a term; one of more than ``MOST_TERMS`` rows is refused."""
    rows = terms.where("term <> '' and weight > 0").groupBy(F.lower("term").alias("term")).agg(F.max("weight").cast("int").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in rows}


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton over both lists; a term in both is strict."""
    terms = ahocorasick.Automaton()
    for kind, words in (("soft", soft), ("strict", strict)):
        for word in words:
            terms.add_word(word.lower(), (kind, word.lower()))
    terms.make_automaton()
    return terms


def hits(url: str | None, terms: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of a url that stand between ends or characters other than a-z and 0-9."""
    text, strict, soft = (url or "").lower(), set(), set()
    if not len(terms):
        return strict, soft
    apart = lambda i: i < 0 or i >= len(text) or not (text[i].isascii() and text[i].isalnum())
    for end, (kind, word) in terms.iter(text):
        if apart(end - len(word)) and apart(end + 1):
            (strict if kind == "strict" else soft).add(word)
    return strict, soft


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES,
               weights: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """Host, path, fitting rule and verdict of every url, with the terms found in it and what they weigh.

    A fitting rule decides; else a url is blocked whose distinct terms weigh ``limit`` or more: one strict term, that weighs so much alone,
    or several soft ones. Terms are looked for in the whole url, of any length, in lower case. A NULL or empty url fits no rule and is
    allowed. Repeated rows give repeated results, columns beside key and url are ignored; no shuffle is needed.
    """
    weights = WEIGHTS if weights is None else weights
    strict = tuple(t for t, w in weights.items() if w >= limit)
    soft = tuple(t for t, w in weights.items() if w < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            found = [hits(u, terms) for u in batch.column(1).to_pylist()]
            out = batch.append_column("strict_terms", pa.array([sorted(a) for a, _ in found], pa.list_(pa.string())))
            out = out.append_column("soft_terms", pa.array([sorted(b) for _, b in found], pa.list_(pa.string())))
            yield out.append_column("weight", pa.array([sum(weights[t] for t in a | b) for a, b in found], pa.int64()))

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    counted = rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, strict_terms array<string>, soft_terms array<string>, weight long")
    host, path = url_parts(F.col("url"))
    said = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return (
        counted.withColumns({"host": host, "path": path}).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", said).alias("verdict"),
                "url", "strict_terms", "soft_terms", "weight"))


#: The same in SQL for the rules and weights above, a pattern for each term in place of the automaton.
SQL = f"""
WITH parts AS (
  SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
named AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, lower(coalesce(url, '')) AS low FROM parts),
rules(rule, said) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
fitting AS (
  SELECT page_id, url, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
  FROM (SELECT DISTINCT page_id, url, host, path FROM named) AS n JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[strpos(rule, '/'):])
  GROUP BY page_id, url),
vocabulary(term, weight) AS (VALUES {", ".join(f"('{t}', {w})" for t, w in sorted(WEIGHTS.items()))}),
urls AS (SELECT DISTINCT url, low FROM named),
met AS (
  SELECT url, term, weight FROM urls JOIN vocabulary ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
summed AS (
  SELECT url, list(term ORDER BY term) FILTER (weight >= {LIMIT}) AS strict_terms, list(term ORDER BY term) FILTER (weight < {LIMIT}) AS soft_terms,
         sum(weight)::BIGINT AS weight FROM met GROUP BY url)
SELECT n.page_id, n.host, n.path, r.rule, coalesce(r.said, CASE WHEN s.weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n.url,
       coalesce(strict_terms, []) AS strict_terms, coalesce(soft_terms, []) AS soft_terms, coalesce(s.weight, 0) AS weight
FROM named AS n LEFT JOIN summed AS s ON s.url = n.url
     LEFT JOIN fitting AS r ON r.page_id IS NOT DISTINCT FROM n.page_id AND r.url IS NOT DISTINCT FROM n.url
"""
