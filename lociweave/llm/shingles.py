"""Word shingles as 64-bit hashes, computed over whole texts with prefix polynomials instead of per-shingle Python."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling to at least ``n`` entries."""
    global _powers, _inverses
    while len(_powers) < n:
        m = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, m, 1 << 64))])
        _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(_INVERSE, m, 1 << 64))])
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, split at runs of bytes 0x09-0x0D and 0x20."""
    return raw.lower().split()


def window_hashes(raw: bytes, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words in order; a shorter text gives one hash of all its words, an empty one none."""
    norm = b" ".join(words_of(raw))
    if not norm:
        return np.empty(0, dtype=np.uint64)
    a = np.frombuffer(norm, dtype=np.uint8)
    powers, inverses = _tables(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers[: len(a)], out=total[1:])
    gaps = np.flatnonzero(a == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(a)]])
    if len(start) <= k:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: len(start) - k + 1], end[k - 1 :]
    return mix((total[end] - total[start]) * inverses[start])


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(window_hashes(raw, k))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())
