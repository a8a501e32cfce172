"""Hashed word features shared by the text classifiers (numpy, one document at a time).

Features of a text are the distinct hashes of its lower-cased words, word
bigrams and skip-grams (one or two words skipped).  Null and empty texts have
no features.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from .common import per_worker

BITS = 20
_WORD = re.compile(r"\w+")
_CACHE_LIMIT = 200_000
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


class WordHashes(dict):
    """word -> 32-bit hash; emptied when it grows past a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.uint32)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature indices (uint32) below 2**bits."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint32)
    lookup = per_worker("feature-words", WordHashes).__getitem__
    h = np.fromiter(map(lookup, words), np.uint64, len(words))
    a = h * _M[0]
    parts = [_fold(a, bits)]
    for gap, mult in ((1, _M[1]), (2, _M[2]), (3, _M[3])):
        if len(h) > gap:
            parts.append(_fold((a[:-gap] ^ (h[gap:] * mult)) * _M[0], bits))
    return np.unique(np.concatenate(parts))
