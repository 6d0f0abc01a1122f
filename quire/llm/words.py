"""Words and hashed word windows of UTF-8 texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed values of the two word rules, as bytes of UTF-8 (every byte from 0x80 on belongs to a non-ASCII character).
#: shingle words: [^\x20\x09-\x0D]+ ; benchmark words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ ; both after lower-casing A-Z.
BENCHMARK_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def shingle_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def benchmark_words(text: bytes) -> list[bytes]:
    return text.translate(BENCHMARK_TABLE).split()


class WordHash(dict):
    """word -> 64-bit hash, remembered for at most `most` words."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive words; the result is shorter than the input by width - 1."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(out)


def shingles(words: list[bytes], seen: WordHash, width: int) -> np.ndarray:
    """The sorted distinct hashes of the `width`-word shingles; a shorter text, not empty, is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(seen.of(words), min(width, len(words))))
