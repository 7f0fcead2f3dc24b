"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Fixed value: what counts as a word once a text is in lower case.
WORD = re.compile(r"\w+")
CACHE = 200_000
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of words, kept between texts."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """The hashes of a whole text's k-word shingles, in order and with repeats. A text of fewer
    than k words is one shingle; without letters or digits, its white-space words count; a null
    or blank text has none."""
    if not text:
        return np.array([], np.uint64)
    words = WORD.findall(text.lower()) or text.split()
    h = hashes.of(words)
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += mix(h[i : len(h) - k + 1 + i] + np.uint64(i)) * _P[i % 5]
        return mix(out)
