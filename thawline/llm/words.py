"""64-bit word hashes, rolling hashes and shingle sets."""
from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashing a short word again takes less time than finding it in a memory of many."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; fewer words give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += hashes[j:j + n]
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def shingles(text: str, k: int) -> np.ndarray:
    """The k-word shingles of a text in order, A-Z in lower case, words between ASCII white space.

    Fewer than k words are one shingle; without words there is none.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return rolling(h, min(k, len(words)))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return np.unique(shingles(text, k))
