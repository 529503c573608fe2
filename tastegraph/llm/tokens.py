"""Token ids of whole texts, encoding each distinct word once as long as a worker remembers it."""

from __future__ import annotations

import functools
import os
import struct

import regex

#: The pre-tokenizer's pattern of the word-end BPE vocabulary, with its white space, that of Unicode, spelled out. Fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Runs a worker remembers before it starts afresh; bounds its memory, not the texts it handles.
REMEMBERED = 500_000
#: Signs that stand alone after a word.
_AFTER = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others as letters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens(dict):
    """Little-endian unsigned 32-bit ids of a run of characters without white space.

    White space always ends a word of this vocabulary and is dropped, so a text's ids are those of its runs in order. The BPE model
    is the tokenizer's own. Words of letters below U+0130, where lower case and composed forms are plain,
    go straight to it; everything else goes through the tokenizer's normalizer and pattern, special tokens through ``encode``.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.find = regex.compile(WORD_PATTERN).findall
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, run: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        plain = run.isascii() or max(run) < "İ"
        if plain and run.isalpha():
            value = self.word(run.lower())
        elif plain and run[-1:] in _AFTER and run[:-1].isalpha():
            value = self[run[:-1]] + self.word(run[-1])
        elif any(s in run for s in self.special):
            value = struct.pack(f"<{len(ids := self.tokenizer.encode(run, add_special_tokens=False).ids)}I", *ids)
        else:
            value = b"".join([self.word(w) for w in self.find(self.tokenizer.normalizer.normalize_str(run))])
        self[run] = value
        return value

    def word(self, word: str) -> bytes:
        """Ids of one word of the pattern, already normal."""
        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each."""
        if not text:
            return b""
        # str.split also splits at these four, which are no white space to the tokenizer
        runs = SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.__getitem__, runs))


SPACE = regex.compile(r"[\t\n\v\f\r ]+")


@functools.cache
def of_worker(path: str) -> WordTokens:
    """The tokens this worker remembers, kept from task to task."""
    return WordTokens(path)
