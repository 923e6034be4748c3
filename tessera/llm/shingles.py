"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words: A-Z lowered, cut at ASCII white space."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    h = pd.util.hash_array(np.array([w for x in words for w in x], dtype=object), categorize=False).astype(np.uint64)
    ends = np.cumsum([0] + [len(x) for x in words])
    return [h[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words, in order; with fewer words, of the whole sequence; none for none."""
    if len(words) == 0:
        return words
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out ^ words[i : i + n])
    return out
