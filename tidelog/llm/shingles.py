"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = 1 << 20):
    """The text in pieces of about ``size`` bytes, cut before a white space."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + size) if start + size < len(text) else None
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit integer to another, one to one, all bits spread (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its runs of ``size`` words, A-Z in lower case; a shorter text has one shingle of all its words, a text without words has none."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    numbers = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in (t.encode().lower().split() for t in texts)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    factor = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for n in numbers:
        h = hashes[n]
        width = min(size, len(h))
        total = np.full(max(len(h) - size + 1, min(len(h), 1)), width, np.uint64)
        for i in range(width):
            total = mix(total * factor + h[i : len(h) - width + 1 + i])
        out.append(np.unique(total))
    return out
