"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and \\t to \\r."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of all words if there are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total + h[i : len(h) - n + 1 + i])
    total.sort()
    return total[np.r_[True, total[1:] != total[:-1]]]


def set_id(shingles: np.ndarray) -> int:
    """One signed 64-bit number for equal sets."""
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x
