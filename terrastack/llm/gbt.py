"""Histogram gradient-boosted trees in numpy: fitted on quantile bins, flattened into arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: row t holds tree t, children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # a value above goes right
    value: np.ndarray  # trees x leaves
    base: float
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """All trees at once over blocks of rows: one gather for each level."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[at : at + 4096] += self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least_rows: int = 8) -> Trees:
    """Logistic loss, second-order splits. Without rows or with one class only the score is a constant."""
    n, k = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    positive = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(positive / (1 - positive)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    features, limits, values, f = [], [], [], np.full(n, base)
    flat = binned + np.arange(k) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            slot = (local[:, None] * (k * bins) + flat).ravel()
            size = width * k * bins
            sums = [np.bincount(slot, weights=np.repeat(w, k), minlength=size).reshape(width, k, bins) for w in (g, h, np.ones(n))]
            left = [s.cumsum(axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[2] < least_rows) | (total[2] - left[2] < least_rows)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), bins)
                if gain[i, j, c] > 1e-9 and c < len(cuts[j]):
                    feature[first + i], limit[first + i] = j, cuts[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        f += value[leaf]
        features.append(feature), limits.append(limit), values.append(value)
    return Trees(np.stack(features), np.stack(limits), np.stack(values), base, depth)
