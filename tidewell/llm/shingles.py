"""Words and five-word shingles of whole texts, as numbers."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Pieces(dict):
    """Memo from blank-delimited pieces to the number of their word.

    ``number`` gives a word's number, 0 or more. Pieces without a word and
    pieces with several have numbers below 0; ``codes`` resolves those.
    """

    EMPTY = -2

    def __init__(self, number: Callable[[str], int], most: int = 250_000):
        self.number, self.most = number, most
        self.several: list[list[int]] = []

    def clear(self) -> None:
        super().clear()
        self.several.clear()

    def __missing__(self, piece: str) -> int:
        low = piece.lower()
        found = [low] if low.isalpha() else WORD.findall(low)
        if len(found) == 1:
            code = self.number(found[0])
        elif not found:
            code = self.EMPTY
        else:
            self.several.append(list(map(self.number, found)))
            code = self.EMPTY - len(self.several)
        self[piece] = code
        return code

    def codes(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words in order."""
        if not text:
            return np.zeros(0, np.int64)
        if len(self) > self.most:
            self.clear()
        pieces = text.replace("\n", " ").split(" ")
        codes = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if codes.min() <= self.EMPTY:
            if (codes < self.EMPTY).any():
                out: list[int] = []
                for c in codes.tolist():
                    out.extend(self.several[self.EMPTY - c - 1] if c < self.EMPTY else (c,))
                codes = np.array(out, np.int64)
            codes = codes[codes != self.EMPTY]
        return codes


def word_number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) >> 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the text's runs of ``width`` words in order; a shorter text is one run."""
    w = codes.astype(np.uint64)
    if not len(w):
        return w
    n, total = max(1, len(w) - width + 1), np.uint64(0)
    total = np.full(n, np.uint64(min(len(w), width)))
    for k in range(min(width, len(w))):
        total = mixed(total * _ODD + w[k : k + n])
    return total


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes made distinct by the number of each occurrence, in text order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return h
    start = np.flatnonzero(np.r_[True, ~same])
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    out = np.empty_like(h)
    out[order] = np.where(nth > 0, mixed(s + nth.astype(np.uint64) * _ODD), s)
    return out
