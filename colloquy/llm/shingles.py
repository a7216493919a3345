"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes kept per Python worker.
KEPT_WORDS = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _known
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def shingle_set(data: bytes, n: int = 5) -> np.ndarray:
    """Distinct shingles of ``n`` words, A-Z lower-cased; of fewer words the whole as one."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(n, len(h))
    m = len(h) - width + 1
    out = np.full(m, width, np.uint64)
    for k in range(width):
        out = out * _M + h[k : k + m]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))
