"""Text normalisation and comparison as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The articles dropped from the front of a title.
LEADING_ARTICLES = ("the", "a", "an", "le", "la", "les", "el", "der", "die", "das")

# Patterns that reduce a provider's offer name to the service behind it, in order.
SERVICE_NAME_RULES = (
    (r"(?i)\s+(?:Amazon|Roku|Apple TV)(?:\s+Premium)?\s+Channel$", ""),
    (r"(?i)^(.*?)\s+Plus\b", "$1+"),  # the first one only
    (r"(?i)\s+(?:with\s+Ads|Ad[-\s]?Free)$", ""),
    (r"(?i)\s+(?:Essential|Premium|Basic|Standard)$", ""),
)

# Substrings that mark a user agent as a crawler or link previewer.
BOT_PATTERN = (
    "(?i)bot|crawler|spider|facebookexternalhit|slackbot|whatsapp|telegram|discord|preview|"
    "curl|wget|headless"
)


def _is_mark(ch: str) -> bool:
    return "̀" <= ch <= "ͯ"


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """From the Unicode tables: characters with a one-letter base, and those that expand to more."""
    single_from, single_to, expanding = [], [], {}
    for code in range(0xA0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x300 <= code <= 0x36F:
            continue
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not _is_mark(c))
        if base == ch:
            continue
        if len(base) == 1:
            single_from.append(ch)
            single_to.append(base)
        else:
            expanding[ch] = base
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    # translate() deletes the characters that have no counterpart, so the marks go last
    return "".join(single_from) + marks, "".join(single_to), expanding


def strip_diacritics(col: Column) -> Column:
    """Compatibility decomposition without combining marks, for the basic multilingual plane."""
    source, target, expanding = _decompositions()
    letters = F.create_map(*[F.lit(x) for pair in expanding.items() for x in pair])
    folded = F.translate(col, source, target)
    # most texts hold no letter that becomes several; it is looked for among the letters beyond ASCII, and each kind of it is replaced at once
    several = F.lit(f"({_any_of(expanding)})")
    foreign = F.regexp_replace(col, r"[\x00-\x7F]+", "")
    kinds = F.array_distinct(F.regexp_extract_all(foreign, several, F.lit(1)))
    expanded = F.reduce(kinds, folded, lambda text, c: F.replace(text, c, letters[c]))
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, col).when(F.regexp_like(foreign, several), expanded).otherwise(folded)


def _any_of(letters: dict[str, str]) -> str:
    """A pattern for any of the letters, neighbours joined to ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def _folded(col: Column) -> Column:
    return F.lower(strip_diacritics(F.coalesce(col, F.lit(""))))


def normalize_title(col: Column) -> Column:
    """Comparison key of a title: folded, without trailing year, leading article and punctuation."""
    c = F.regexp_replace(_folded(col), r"\s*\([0-9]{4}\)\s*$", "")
    c = F.regexp_replace(c, r"^(" + "|".join(LEADING_ARTICLES) + r")\s+", "")
    return F.regexp_replace(c, "[^a-z0-9]+", "")


def normalize_person_name(col: Column) -> Column:
    """Folded name whose words stay apart by single spaces."""
    return F.trim(F.regexp_replace(_folded(col), "[^a-z0-9]+", " "))


def person_sort_name(col: Column) -> Column:
    """Normalised name with its last word moved to the front."""
    return F.regexp_replace(normalize_person_name(col), "^(.*) ([^ ]+)$", "$2 $1")


def reversed_name_key(col: Column) -> Column:
    """Normalised name with all its words in reverse order."""
    return F.array_join(F.reverse(F.split(normalize_person_name(col), " ")), " ")


def slugify(col: Column, suffix: Column | None = None) -> Column:
    """URL slug of at most 80 characters, ``untitled`` when nothing is left, plus a suffix."""
    c = F.regexp_replace(_folded(col), "[^a-z0-9]+", "-")
    c = F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, 80)
    safe = F.coalesce(F.nullif(c, F.lit("")), F.lit("untitled"))
    if suffix is None:
        return safe
    tail = F.nullif(suffix.cast("string"), F.lit(""))
    return F.when(tail.isNull(), safe).otherwise(F.concat_ws("-", safe, tail))


def trigrams(col: Column) -> Column:
    """Distinct three-letter pieces of the text padded by two blanks before and one after."""
    padded = F.concat(F.lit("  "), col, F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of the two texts' trigram sets; 1 for equal texts, 0 when one is empty."""
    return trigram_overlap(a, b, trigrams(a), trigrams(b))


def trigram_overlap(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """``trigram_similarity`` for texts whose trigram sets are already at hand."""
    shared = F.size(F.array_intersect(grams_a, grams_b))
    union = F.size(grams_a) + F.size(grams_b) - shared
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(shared / union)
    )


def service_name(col: Column) -> Column:
    """Provider offer name reduced to the service a person would name."""
    for pattern, replacement in SERVICE_NAME_RULES:
        col = F.regexp_replace(col, pattern, replacement)
    return F.trim(col)


def is_bot(user_agent: Column) -> Column:
    """True for crawlers and link previewers; a request without an agent is not one."""
    return F.coalesce(user_agent.rlike(BOT_PATTERN), F.lit(False))
