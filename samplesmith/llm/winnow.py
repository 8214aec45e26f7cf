"""Rolling hashes and window minima over whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
SLOT = 23  # bits of a key that hold the place, so a block has at most 2**SLOT places
BLOCK = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values, by doubling; empty if there are fewer."""
    if len(a) < k:
        return np.empty(0, np.uint64)
    power = a.astype(np.uint64) + np.uint64(1)
    size, out, done = 1, None, 0
    while size <= k:
        if k & size:
            n = len(a) - done - size + 1
            part = power[done:done + n] if out is None else out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + power[done:done + n]
            out, done = part, done + size
        if 2 * size <= k:
            power = power[:len(power) - size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
        size *= 2
    return mix(out[:len(a) - k + 1])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:len(x) - size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def minimizers(h: np.ndarray, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of ``w`` hashes that share their least hash (the first of equals).

    Blocks of (first window, number of windows, place of the least hash).  The
    place depends on the window's own hashes alone, so equal windows agree on it.
    """
    total = len(h) - w + 1
    for at in range(0, total, BLOCK):
        part = h[at:min(at + BLOCK, total) + w - 1]
        key = (part >> np.uint64(SLOT) << np.uint64(SLOT)) | np.arange(len(part), dtype=np.uint64)
        place = (window_min(key, w) & np.uint64((1 << SLOT) - 1)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
        yield first + at, np.diff(np.r_[first, len(place)]), place[first] + at
