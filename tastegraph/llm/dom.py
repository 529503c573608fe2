"""Leaf blocks of an html page: runs of text between the borders of block elements, with the elements they lie in."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass

#: Elements whose text belongs to the line around them; all others are borders of blocks. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "wbr img br input button select".split())
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Fixed values.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
#: A start tag on the left ends an open element on the right. Fixed values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where looking for such an element, or for a paragraph left open, stops. Fixed values.
SCOPE = frozenset("table ul ol dl body article section main div aside nav header footer form blockquote figure".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A block's text, white space made single; its own element; names of the elements around it and of their classes; how much of it is links."""

    text: str
    own: str
    around: tuple[str, ...]
    linked: float
    marked: bool


class _Open:
    """The open elements, and how many of them bear each name, so that a block costs what changed since the one before."""

    def __init__(self, known: Container[str] | None) -> None:
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []
        self.borders: list[str] = []
        self.tags: Counter[str] = Counter()
        self.names: dict[str, int] = {}
        self.marked = 0
        self.told: tuple[str, ...] | None = ()

    def push(self, tag: str, words: tuple[str, ...], marked: bool) -> None:
        names: tuple[str, ...] = ()
        if tag not in INLINE:
            self.borders.append(tag)
            names = tuple(n for n in (f"in:{tag}", *[f"class:{w}" for w in words]) if self.known is None or n in self.known)
            for n in names:
                self.names[n] = self.names.get(n, 0) + 1
                if self.names[n] == 1:
                    self.told = None
        self.stack.append((tag, names, marked))
        self.tags[tag] += 1
        self.marked += marked

    def pop(self) -> str:
        tag, names, marked = self.stack.pop()
        for n in names:
            self.names[n] -= 1
            if not self.names[n]:
                del self.names[n]
                self.told = None
        if tag not in INLINE:
            self.borders.pop()
        self.tags[tag] -= 1
        self.marked -= marked
        return tag

    def around(self) -> tuple[str, ...]:
        if self.told is None:
            self.told = tuple(sorted(self.names))
        return self.told


def _names(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Lower-case words of class, id and role, ``hidden`` for what is not shown; whether the element is marked as main text."""
    words: list[str] = []
    marked = False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name in ("class", "id", "role"):
            words += [w.lower() for w in _NAME.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.append("hidden")
        elif name == "data-main":
            marked = True
    return tuple(dict.fromkeys(words)), marked


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order; a page cut off anywhere gives what came before.

    With ``known``, only names in it are told of the elements around a block. Memory and time then grow with the page alone, however deep
    its elements nest.
    """
    found: list[Block] = []
    open_ = _Open(known)
    parts: list[str] = []
    in_link = 0

    def flush() -> None:
        nonlocal in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, open_.borders[-1] if open_.borders else "none", open_.around(), min(1.0, in_link / len(text)), open_.marked > 0))
            parts.clear()
        in_link = 0

    def say(raw: str) -> None:
        nonlocal in_link
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if open_.tags["a"]:
            in_link += len(text.strip())

    page = page or ""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag not in INLINE:
                flush()
            if open_.tags[tag]:
                while open_.pop() != tag:
                    pass
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in VOID:
            if tag in INLINE:
                parts.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
            closes = ENDS.get(tag, frozenset())
            if open_.tags["p"] or any(open_.tags[c] for c in closes):
                _close(open_, closes)
        names, marked = _names(m["attrs"]) if m["attrs"].strip() else ((), False)
        open_.push(tag, names, marked)
    flush()
    return found


def _close(open_: _Open, closes: Container[str]) -> None:
    """End what a start tag ends: an open paragraph, or the nearest of ``closes`` and a paragraph inside it."""
    upto = None
    for i in range(len(open_.stack) - 1, -1, -1):
        tag = open_.stack[i][0]
        if tag == "p" or tag in closes:
            upto = i
            if tag == "p" and not closes:
                break
        elif tag in SCOPE:
            break
    while upto is not None and len(open_.stack) > upto:
        open_.pop()
