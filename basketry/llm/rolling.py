"""Hashes of all word windows of one text, with numpy."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n (a power of two or more)."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        got = (both[0], both[1])
        if size <= 1 << 20:  # very long texts do not stay in memory
            _powers[base] = got
    return got


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` consecutive values; ``which``
    picks one of two independent families."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _power(_BASES[which], n + 1)
    if which:
        hashes = mix(hashes ^ np.uint64(_BASES[1]))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * down[:n], out=total[1:])
    # each window's sum, brought to the same power: base^-(start) cancels
    return mix((total[length:] - total[:-length]) * up[:n - length + 1])


def minima(values: np.ndarray, span: int) -> np.ndarray:
    """Positions of the leftmost least value of every ``span`` consecutive
    values (each position once).  Empty if there are fewer."""
    if len(values) < span:
        return np.empty(0, np.int64)
    out = []
    step = 1 << 16
    for at in range(0, len(values) - span + 1, step):
        part = np.lib.stride_tricks.sliding_window_view(values[at:at + step + span - 1], span)
        where = part.argmin(axis=1) + np.arange(at, at + len(part))
        out.append(where[np.r_[True, where[1:] != where[:-1]]])
    return np.unique(np.concatenate(out))
