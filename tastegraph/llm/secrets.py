"""Secrets in texts: fixed patterns, and values in a credential's context that a guess-cost segmentation finds hard to guess."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.words import CACHE, pieces

#: Patterns of the base kinds, in the order of ties. Fixed values.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a credential may be named and its value follow, wider than the base kind. The value is looked at, not taken: it may be
#: a name itself, with the value behind it.
CONTEXT = re.compile(
    r"(?ai)(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pw|pin|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|"
    r"credentials?|auth|bearer|login)(?![a-z0-9])[\"'\x20]*(?:(?:is|was|(:=|=>|->|[:=]))[\x20\"'`]*|\x20[\"'`]?)(?=[^\s\"'`,;<>(){}\[\]]{6})")
#: Where a value ends, and characters of it that are priced at once.
END, PIECE = re.compile(r"[\s\"'`,;<>(){}\[\]]"), 256
#: Guesses, as a power of ten, from which a value counts as a secret.
LEAST_GUESSES = 10.0
#: The same for the longest word of a value that reads like words, as in prose.
PROSE_GUESSES = 30.0
#: Characters that a run by brute force may take, by class: how many there are of each. Fixed values.
CARDINALITY = {"lower": 26, "upper": 26, "digit": 10, "other": 33}
#: Common parts of passwords and words of everyday use by rank; the guess cost of one is its rank. Fixed values.
WORDS = (
    "password", "admin", "welcome", "letmein", "qwerty", "secret", "login", "master", "dragon", "monkey", "football", "baseball", "sunshine",
    "princess", "iloveyou", "shadow", "superman", "trustno", "pass", "user", "test", "guest", "root", "hello", "love", "summer", "winter",
    "spring", "autumn", "freedom", "whatever", "starwars", "computer", "example", "changeme", "default", "token", "key", "value", "the", "and",
    "for", "with", "that", "this", "from", "have", "your", "not", "are", "was", "been", "will", "would", "there", "their", "what", "which",
    "about", "when", "make", "can", "like", "time", "just", "know", "take", "people", "into", "year", "good", "some", "could", "them", "see",
    "other", "than", "then", "now", "look", "only", "come", "over", "think", "also", "back", "after", "use", "two", "how", "our", "work",
    "first", "well", "way", "even", "new", "want", "because", "any", "these", "give", "day", "most", "required", "reset", "forgot", "protected",
    "manager", "policy", "string", "number", "placeholder", "redacted", "none", "null", "true", "false", "undefined",
)
#: Rows of a keyboard, along which a walk goes. Fixed values.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Letters written as other signs. Fixed values.
LEET = str.maketrans("@4310$5!7", "aaeiossit")

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_NEXT = {(a, b) for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:1[0-2]|0?[1-9])(?:[-/._]?(?:[12]\d|3[01]|0?[1-9]))?)?|(?:[12]\d|3[01]|0?[1-9])[-/._](?:1[0-2]|0?[1-9])[-/._](?:19|20)?\d\d")


def _class(c: str) -> str:
    return "digit" if "0" <= c <= "9" else "lower" if c.islower() else "upper" if c.isupper() else "other"


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Least guesses for a value, as a power of ten, over all its cuts into spans, and the spans (start, end, kind) of the best cut.

    A span is a word (its rank, more for capitals or signs for letters), a date, a repeat of a shorter part, a keyboard walk
    or a run, or brute force (the size of the value's alphabet to the power of its length). Each further span
    costs a factor for its order. An empty value costs nothing.
    """
    n, lower = len(value), value.lower()
    plain = lower.translate(LEET) if len(lower) == n else value
    alphabet = sum(CARDINALITY[k] for k in {_class(c) for c in value}) or 1
    single = math.log10(alphabet)
    ends: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(plain[i:j])
            if rank:
                changed = (value[i:j] != lower[i:j]) + (plain[i:j] != lower[i:j])
                ends[j].append((i, math.log10(rank) + 0.3 + 0.5 * changed, "word"))
        m = _DATE.match(value, i)
        if m and m.end() - i >= 4:
            ends[m.end()].append((i, 4.6 if m.end() - i > 4 else 2.1, "date"))
        j = i + 1
        while j < n and (lower[j - 1], lower[j]) in _NEXT:
            j += 1
        if j - i >= 3:
            ends[j].append((i, math.log10(47 * (j - i) * 2), "walk"))
        for step in (1, -1):
            j = i + 1
            while j < n and ord(value[j]) - ord(value[j - 1]) == step:
                j += 1
            if j - i >= 3:
                ends[j].append((i, math.log10(26 * (j - i)), "walk"))
        for width in range(1, min(8, (n - i) // 2) + 1):
            j = i + width
            while j + width <= n and value[j : j + width] == value[i : i + width]:
                j += width
            if j - i >= 2 * width and j - i >= 3:
                ends[j].append((i, width * single + math.log10((j - i) // width), "repeat"))
    best = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    for j in range(1, n + 1):
        # brute force grows a character at a time and pays for its start once
        grown = best[j - 1][0] + single + (0.0 if best[j - 1][2] == "brute" else 0.3 * (j > 1))
        best[j] = (grown, j - 1, "brute")
        for i, cost, kind in ends[j]:
            total = best[i][0] + cost + 0.3 * (i > 0)
            if total < best[j][0]:
                best[j] = (total, i, kind)
    spans, j = [], n
    while j > 0:
        i, kind = best[j][1], best[j][2]
        if spans and kind == "brute" == spans[-1][2]:
            spans[-1] = (i, spans[-1][1], kind)
        else:
            spans.append((i, j, kind))
        j = i
    return best[n][0], spans[::-1]


_JOINED = re.compile(r"(?:[^\W\d]|[-./:*–—…])+")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")


def long_cost(value: str) -> float:
    """Guess cost of a value of any length: that of its hardest piece, so that the work grows with the length."""
    return max((guess_cost(p)[0] for p in {value[i : i + PIECE] for i in range(0, len(value), PIECE)}), default=0.0)


#: Consonants in a row that no word has, and the least share of vowels, in hundredths, of a longer word.
CONSONANTS, VOWELS = 6, 20
_HARD = re.compile(rf"[b-df-hj-np-tv-xz]{{{CONSONANTS}}}", re.I)
_SOFT = re.compile(r"[^b-df-hj-np-tv-xz]", re.I)
#: Small letters that hardly ever follow each other in words of European languages. Fixed values.
_ODD = re.compile(r"q(?!u)|[jqv][bcdfghjkmnpqstvwxz]|[fgkpvw][jqxz]")
#: A url, its part before the host if it has one, and the password in that.
_URL = re.compile(r"(?ai)[a-z][a-z0-9+.-]*://(?:([^/?#@\s]*)@)?[^/?#\s]")


def like_words(value: str) -> bool:
    """Letters joined by signs of prose, names and paths alone, that can be spoken and whose case changes as in words and names put together."""
    runs = _LETTERS.findall(value)
    if not runs or not _JOINED.fullmatch(value) or (len(_WORD.findall(value)) - len(runs)) * 4 > sum(map(len, runs)):
        return False
    return all(not _HARD.search(r) and not _ODD.search(r) and (len(r) < CONSONANTS or len(_SOFT.findall(r)) * 100 >= VOWELS * len(r)) for r in runs)


def find_secrets(text: str | None, least: float = LEAST_GUESSES, known: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in a whole text, in code points, by start and then by kind.

    Kinds are assign, access and hex, found leftmost and without overlap each, and guess: a value in a credential's context that
    takes 10 ** ``least`` guesses or more and reaches beyond the other spans. A value that reads like words, as prose may follow a name, is a
    secret if one of its words takes 10 ** ``PROSE_GUESSES``, a url if the password in it takes 10 ** ``least``.
    """
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    known = {} if known is None else known
    taken: list[tuple[int, int]] = []  # without overlap
    for a, b in sorted((s, e) for _, s, e in found):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    stop = judged = 0  # end of the word at hand, up to where values are judged
    names = list(CONTEXT.finditer(text))
    starts = {m.start() for m in names}
    for m in names:
        s = m.end()
        if s < judged or s in starts:
            continue
        if s >= stop:
            stop = end.start() if (end := END.search(text, s)) else len(text)
        value = text[s:stop].rstrip(".:!?")
        e = s + len(value)
        at = bisect_right(taken, (s, len(text))) - 1
        if len(value) < 6 or at >= 0 and e <= taken[at][1]:
            continue
        link = _URL.match(value)
        prose = like_words(value)
        if not prose:
            judged = stop  # what follows inside it costs no more
        if link:
            # of a url only a password in it is a secret
            priced, limit = (link[1] or "").partition(":")[2], least
        else:
            priced, limit = (max(_LETTERS.findall(value), key=len).lower(), PROSE_GUESSES) if prose else (value, least)
        cost = known.get(priced)
        if cost is None:
            cost = long_cost(priced)
            if len(known) >= CACHE // 10:
                known.clear()
            if len(priced) <= PIECE:
                known[priced] = cost
        if cost >= limit:
            found.append(("guess", s, e))
            judged = stop
    order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
    return sorted(found, key=lambda f: (f[1], order[f[0]], f[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(documents: DataFrame, least: float = LEAST_GUESSES) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, all spans, and the number the guess cost added.

    NULL and empty texts have no spans. Texts and values of any length are read whole. Repeated rows give repeated results; columns beside
    doc_id and text are ignored. No row meets another, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for rows in pieces(batches):
            out = []
            for text in rows["text"]:
                spans = find_secrets(text, least, known)
                base = [s for s in spans if s[0] != "guess"]
                counts = [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64())] + [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
