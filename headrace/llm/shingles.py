"""Word shingles as 64-bit hashes, vectorised over a text."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_ODD = np.random.default_rng(5).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Hashes of all ``size``-word shingles in their order; fewer words are one shingle, no words none.

    64 bits: two different shingles of one pair of texts with n shingles meet with odds n^2 / 2^64.
    """
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        out = (out + hashes[j:j + len(out)]) * _ODD[j]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The same, sorted and distinct."""
    return np.unique(shingle_hashes(words, size))
