"""Vectorised tokenisation: whole batches of text as one array of code points.

A batch is encoded once to UTF-32; words, their hashes and their statistics then come from a few
array passes instead of a Python loop over words.
"""

from __future__ import annotations

import re

import numpy as np

#: Latin letters that look like Cyrillic ones (either case), folded in every word.
_LOOKALIKE = dict(zip("abcehkmoptxy", "авсенкмортху"))
_DROPPED = "­​‌‍⁠﻿́̀-‐‑'’ʼ`"
_TAG = re.compile(r"<[!/?a-zA-Z][^<>]{0,200}>|&(?:nbsp|amp|quot|lt|gt|laquo|raquo|mdash|ndash|#\d{1,6});")
SPACE, LETTER, DIGIT, STOP, COMMA, OTHER = range(6)
_SIZE = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_SIZE + 1, OTHER, np.uint8)
    fold = np.arange(_SIZE + 1, dtype=np.uint32)
    for c in range(_SIZE):
        ch = chr(c)
        if ch.isalpha():
            kind[c] = LETTER
            low = ch.lower()
            low = {"ё": "е"}.get(low, low)
            fold[c] = ord(_LOOKALIKE.get(low, low)) if len(low) == 1 else c
        elif ch.isdigit():
            kind[c] = DIGIT
        elif ch.isspace() or c < 32:
            kind[c] = SPACE
        elif ch in ".!?…":
            kind[c] = STOP
        elif ch in ",;:—–":
            kind[c] = COMMA
    return kind, fold


KIND, FOLD = _tables()
_DROP = np.zeros(_SIZE + 1, bool)
_DROP[[ord(c) for c in _DROPPED]] = True
_FOLD64 = (FOLD.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, kept and grown between batches."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def without_markup(text: str) -> str:
    """Tags and character references replaced by a blank."""
    return _TAG.sub(" ", text) if "<" in text or "&" in text else text


class Words:
    """The words of a batch: ``doc`` (text number), ``start``, ``length``, ``kind`` and ``code`` (64-bit hash)."""

    def __init__(self, texts: list[str | None], hashes: bool = True):
        clean = [without_markup(t) if t else "" for t in texts]
        self.n_texts = len(clean)
        joined = "\n".join(clean) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.minimum(cp, _SIZE)
        lengths = np.fromiter((len(t) for t in clean), np.int64, len(clean)) + 1
        ends = np.cumsum(lengths)
        drop = _DROP[cp]
        kind = KIND[cp]
        # a point or comma between two digits belongs to the number
        inner = np.zeros(len(cp), bool)
        digit = kind == DIGIT
        inner[1:-1] = digit[:-2] & digit[2:] & ((cp[1:-1] == 46) | (cp[1:-1] == 44))
        keep = ~(drop | inner)
        shift = np.cumsum(~keep)
        ends = ends - shift[ends - 1]
        cp, kind = cp[keep], kind[keep]
        self.points, self.point_kind, self.text_end = cp, kind, ends
        word = (kind == LETTER) | (kind == DIGIT)
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        self.start = np.flatnonzero(edge == 1)
        self.length = np.flatnonzero(edge == -1) - self.start
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.is_number = kind[self.start] == DIGIT
        if hashes:
            self.code = self._codes(cp)

    def _codes(self, cp: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        # polynomial prefix hashes: a word's hash is a difference, shifted back to position 0
        run = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_FOLD64[cp] * _power_table(_BASE, len(cp))[: len(cp)], out=run[1:])
        code = (run[self.start + self.length] - run[self.start]) * _power_table(_INVERSE, len(cp))[self.start]
        code ^= code >> np.uint64(29)
        return code * np.uint64(0xBF58476D1CE4E5B9)

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_texts + 1))


def slices(texts: list[str | None], most: int = 1_000_000):
    """(first, last) index pairs whose texts hold at most ``most`` characters; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
