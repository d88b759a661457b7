"""Sampling places by the smallest hash of a window, so that equal stretches are sampled at equal places."""

from __future__ import annotations

import numpy as np


def leftmost_minima(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, first): for windows of ``w`` hashes, the places that hold a leftmost minimum and the first window of each.

    A place's windows run from its ``first`` to the next place's; together they are all len(h) - w + 1 windows.
    """
    n = len(h) - w + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, size = h, 1
    while 2 * size <= w:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:n], low[w - size : w - size + n])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place, first = [], []
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist()):
        # A stretch of windows with one smallest hash; the place moves on where a window leaves it behind.
        least = low[a]
        while a < b:
            place.append(at := a + int((h[a : a + w] == least).argmax()))
            first.append(a)
            a = at + 1
    return np.array(place, np.int64), np.array(first, np.int64)
