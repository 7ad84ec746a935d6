"""Word shingles as 64-bit hashes, and MinHash signatures, by arrays of many documents.

Words are the runs of non-white characters of the lower-cased whole text. A
text of fewer words than a shingle has is one shingle; a null, empty or white
text has none.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

SHINGLE = 5
_CACHE = 300_000


class WordHashes(dict):
    """Word to 64-bit hash; forgets all beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str], hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, in order and with repeats."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m])
    return out


def many_shingles(lists: list[list[str]], hashes: WordHashes, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles of many texts at once, equal to ``shingle_hashes`` of each; every text has at least ``n`` words."""
    sizes = np.array([len(x) for x in lists], np.int64)
    if not len(sizes):
        return np.empty(0, np.uint64), sizes
    w = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    m = len(w) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m])
    ends = np.repeat(np.cumsum(sizes), sizes)[:m]
    return out[np.arange(n, m + n) <= ends], sizes - n + 1  # windows within one text


def text_key(words: list[str]) -> bytes:
    """128 bits that stand for the sequence of words."""
    return xxhash.xxh128_digest("\x1f".join(words).encode("utf-8", "surrogatepass"))


class MinHash:
    """Signatures of ``size`` 32-bit minima, reproducible from the seed."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
        self.size = size

    def of(self, parts: list[np.ndarray]) -> np.ndarray:
        """A row for each array of shingle hashes; none may be empty."""
        return self.flat(np.concatenate(parts), np.array([len(p) for p in parts], np.int64)) if parts else np.empty((0, self.size), np.uint32)

    def flat(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same for hashes in one array; works through bounded runs of whole texts."""
        out = np.empty((len(counts), self.size), np.uint32)
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            begin = int(ends[first] - counts[first])
            last = max(int(np.searchsorted(ends, begin + (1 << 16), side="right")), first + 1)
            x = (shingles[begin : int(ends[last - 1])] >> np.uint64(32)).astype(np.uint32)
            starts = ends[first:last] - counts[first:last] - begin
            for j in range(self.size):
                y = x ^ self.flip[j]
                y *= self.times[j]
                out[first:last, j] = np.minimum.reduceat(y, starts)
            first = last
        return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (len(a) + len(b) - both)
