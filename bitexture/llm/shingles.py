"""Hashes of word runs, vectorized."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_U = np.uint64
_WORD = re.compile(r"\w+")
_CACHE = 500_000
_PLACES = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)


def scrambled(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of the input over the output."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


class Shingler:
    """64-bit hashes of runs of ``width`` words (``\\w+``, lower case); a shorter
    text is one run, one without words has none. Word hashes are remembered."""

    def __init__(self, width: int = 5) -> None:
        self.width = width
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:

        words = _WORD.findall((text or "").lower())
        if len(self.known) > _CACHE:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def runs(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the runs of words with hashes ``h``."""
        width = self.width
        if 0 < len(h) < width:
            h = np.concatenate([h, np.zeros(width - len(h), np.uint64)])
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = h[:n] * _PLACES[0]
        for i in range(1, width):
            out += h[i : i + n] * _PLACES[i]
        return scrambled(out)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.runs(self.words(text))
