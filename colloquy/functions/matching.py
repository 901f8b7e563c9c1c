"""Optimal one-to-one matching."""

from __future__ import annotations

import numpy as np


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns, one to one, of greatest total gain; every row or every column is used."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    price_r, price_c, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, col = r, 0.0, -1
        while True:
            reduced = base + cost[at] - price_r[at] - price_c
            better = ~done & (reduced < dist)
            dist[better], via[better] = reduced[better], col
            col = int(np.where(done, np.inf, dist).argmin())
            base, done[col] = dist[col], True
            if owner[col] < 0:
                break
            at = owner[col]
        settled = done & (np.arange(m) != col)
        price_r[r] += base
        price_r[owner[settled]] += base - dist[settled]
        price_c[settled] -= base - dist[settled]
        while via[col] >= 0:
            owner[col], col = owner[via[col]], via[col]
        owner[col] = r
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if turned else (r, c) for r, c in pairs)
