"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE, _MIX = np.uint32(16777619), np.uint32(2654435761)


def positions(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between two spaces, end to end; and where each text starts (one
    entry more than texts)."""
    padded = [f" {t.lower()} " for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in padded], out=starts[1:])
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def hashed(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the feature number (0 to 2**bits - 1) of the n-gram at each position, a mask that is false where
    an n-gram would cross the end of its text, and where each text starts."""
    points, starts = positions(texts)
    h = points.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * _BASE + points[n - 1 :] if len(points) >= n else h[:0]
        if n in orders:
            ids = ((h + np.uint32(n * 97)) * _MIX) >> np.uint32(32 - bits)
            inside = np.ones(len(ids), bool)
            for k in range(1, n):
                cut = starts[1:] - k
                inside[cut[(cut >= 0) & (cut < len(ids))]] = False
            yield ids, inside, starts
