"""Five-word shingles of many texts at once, as numpy arrays of 64-bit hashes; and their exact weighted similarity."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of the words of all texts, len(texts) + 1 offsets, and a 16-byte digest of each text's words.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.
    """
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[data]
    change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    first, last = change[::2], change[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
        words = mixed((total[last] - total[first]) * _powers(_BACK, len(data))[first]) if len(first) else np.zeros(0, np.uint64)
    edges = np.searchsorted(first, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return words, edges, digests


def shingle_sets(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[bytes | None]]:
    """For each text its different shingles and their counts, and the digest of its words (None: no words).

    A text with one to four words has one shingle, all of them.
    """
    words, edges, digests = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WIDTH + 1)
        runs = np.zeros(n, np.uint64)
        for k, factor in enumerate(_powers(_MIX2 | np.uint64(1), WIDTH + 1)[1:]):
            runs += words[k : k + n] * factor
        runs = mixed(runs)
    sets, names = [], []
    for a, b, digest in zip(edges[:-1], edges[1:], digests, strict=True):
        if b - a >= WIDTH:
            sets.append(np.unique(runs[a : b - WIDTH + 1], return_counts=True))
        elif b > a:
            sets.append((np.frombuffer(digest[:8], np.uint64), np.ones(1, np.int64)))
        else:
            sets.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        names.append(digest if b > a else None)
    return sets, names


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller counts over the sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - shared
    return shared / either if either else 0.0
