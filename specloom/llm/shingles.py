"""Word shingles as sorted arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_P = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class WordHashes(dict):
    """Hash of each word seen, forgotten when there are ``most`` of them."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, seen: WordHashes) -> np.ndarray:
    """Hashes of the words of a text; A-Z count as a-z, white space is space and U+0009 to U+000D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P[0]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, seen: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles.

    A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    w = word_hashes(text, seen)
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mixed(h * _P[1] + w[i : i + n])
    return np.unique(h)
