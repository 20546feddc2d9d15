"""Gradient-boosted trees for a yes/no label, on binned features, in numpy: small models, fitted on the driver."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)


class Trees:
    """Complete trees of one depth: ``feature`` and ``limit`` by node, ``value`` by leaf."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting; each node takes the split of largest gain among the features' quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, limits, values = [], [], []
    # features of one edge (yes or no) are summed for all at once, by a product
    two = np.array([j for j in range(d) if len(edges[j]) == 1], int)
    more = [j for j in range(d) if len(edges[j]) > 1]
    below = (code[:, two] == 0).astype(float).T
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-9
        at = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            node = at - first
            best = np.full(k, 1e-9)
            pick = [(0, bins)] * k
            total_g, total_h = np.bincount(node, g, k), np.bincount(node, h, k)

            def gains(left_g, left_h, total_g=total_g, total_h=total_h):
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
                gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                return gain

            if len(two):
                member = np.zeros((n, 2 * k))
                member[np.arange(n), node], member[np.arange(n), k + node] = g, h
                sums = below @ member
                gain = gains(sums[:, :k], sums[:, k:])
                c = gain.argmax(0)
                for i in np.flatnonzero(gain[c, np.arange(k)] > best):
                    best[i], pick[i] = gain[c[i], i], (int(two[c[i]]), 0)
            for j in more:
                flat = node * bins + code[:, j]
                left_g = np.bincount(flat, g, k * bins).reshape(k, bins).cumsum(1)[:, :-1]
                left_h = np.bincount(flat, h, k * bins).reshape(k, bins).cumsum(1)[:, :-1]
                gain = gains(left_g, left_h, total_g[:, None], total_h[:, None])
                c = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(k), c] > best):
                    best[i] = gain[i, c[i]]
                    pick[i] = (j, int(c[i]))
            for i, (j, c) in enumerate(pick):
                f[first + i] = j
                t[first + i] = edges[j][c] if c < len(edges[j]) else np.inf
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += v[leaf]
        features.append(f), limits.append(t), values.append(v)
    return Trees(base, np.array(features), np.array(limits), np.array(values))
