"""Intervals laid over each other: which one lies on top at each place."""

from __future__ import annotations

import numpy as np


def places(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of group and instant in order, and the number of each given pair among them."""
    order = np.lexsort((at, group))
    g, t = group[order], at[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    number = np.empty(len(g), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return g[fresh], t[fresh], number


def top_cover(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of n places, the number of the last interval [first, last) that covers each; -1 where none does.

    An interval is two overlapping stretches of a power of two places; the greatest number of each is noted, and is handed down from every power
    to the next, so that no interval is walked.
    """
    power = np.frexp((last - first).astype(float))[1] - 1  # the greatest k with 2**k <= last - first
    levels = [np.full(n, -1, dtype=np.int64) for _ in range(int(power.max(initial=0)) + 1)]
    number = np.arange(len(first))
    for k in range(len(levels) - 1, -1, -1):
        own = np.flatnonzero(power == k)
        np.maximum.at(levels[k], first[own], number[own])
        np.maximum.at(levels[k], last[own] - (1 << k), number[own])
        if k:
            half = 1 << (k - 1)
            np.maximum(levels[k - 1], levels[k], out=levels[k - 1])
            np.maximum(levels[k - 1][half:], levels[k][:-half], out=levels[k - 1][half:])
    return levels[0]
