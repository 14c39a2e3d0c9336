"""Token ids of whole texts by a word-level tokenizer, quickly where texts share words.

The tokenizer cuts a text into pieces (words, digits, runs of other signs), drops the white
space, and merges each piece by itself. So each distinct piece meets the tokenizer once and
is then looked up. Texts of plain Latin letters are cut here, by the tokenizer's pattern;
all others by the tokenizer's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# Pieces that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 19
# Below this sign there are no combining marks, and small letters are found one by one.
_PLAIN_END = 0x130


def _signs(kind: str) -> str:
    """The plain signs of a Unicode category, for use in a pattern."""
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END)
                   if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _NUMBERS, _SPACES = _signs("L"), _signs("N"), "\t-\r \x85\xa0"
_BEYOND = re.compile(f"[{chr(_PLAIN_END)}-\U0010ffff]")
# The tokenizer's pattern.
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_PRINTABLE = re.compile("[!-~]+")


class WordEncoder:
    """Ids of whole texts as the tokenizer file gives them; the strings of its special
    tokens are ordinary text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self._tokenizer = Tokenizer.from_file(path)
        self._remembered = remembered
        self._plain: dict[str, bytes] = {}  # ids of pieces as written
        self._mapped: dict[str, bytes] = {}  # ids of pieces in the tokenizer's byte letters

    def encode(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit numbers, lowest byte first; none of a null text."""
        text = text or ""
        if _BEYOND.search(text):
            clean = self._tokenizer.normalizer.normalize_str(text)
            pieces = [p for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(clean)]
            if len(self._mapped) > self._remembered:
                self._mapped = {}
            known, merge = self._mapped, self._merged
        else:
            pieces = _PIECES.findall(text.lower())
            if len(self._plain) > self._remembered:
                self._plain = {}
            known, merge = self._plain, self._merged_plain
        for piece in set(pieces).difference(known):
            known[piece] = merge(piece)
        return b"".join(map(known.__getitem__, pieces))

    def _merged(self, mapped: str) -> bytes:
        return np.array([t.id for t in self._tokenizer.model.tokenize(mapped)], "<u4").tobytes()

    def _merged_plain(self, piece: str) -> bytes:
        if _PRINTABLE.fullmatch(piece):
            return self._merged(piece)
        return b"".join(self._merged(p) for p, _ in
                        self._tokenizer.pre_tokenizer.pre_tokenize_str(piece))


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps what it remembers from task to task."""
    return WordEncoder(path)
