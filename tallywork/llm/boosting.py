"""Histogram gradient-boosted trees for two classes; the fitted forest is a few flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees one after another. A leaf points to itself, so every row takes the same number of steps."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. Rows and trees move down together; a missing value goes left."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.limit[node]
            node = np.where(right, self.right[node], self.left[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Newton boosting on the logistic loss over binned features. With one class or no rows the forest is a constant."""
    n, width = x.shape
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if n else [np.zeros(0)] * width
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1) if n else np.zeros((0, width), int)
    cell = binned + np.arange(width) * bins
    margin = np.full(n, base)
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(feature)
        for column, item in ((feature, 0), (limit, np.inf), (left, at), (right, at), (value, v)):
            column.append(item)
        return at

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        at = leaf(-rate * total_g / (total_h + ridge))
        if level == depth or len(rows) < 2:
            return at
        flat = cell[rows].ravel()
        sums = [np.bincount(flat, np.repeat(w[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1] for w in (g, h)]
        lg, lh = sums
        rg, rh = total_g - lg, total_h - lh
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - total_g**2 / (total_h + ridge)
        gain[(lh < least) | (rh < least)] = 0
        best = int(np.argmax(gain))
        f, b = divmod(best, bins - 1)
        if gain[f, b] <= 1e-6 or b >= len(edges[f]):
            return at
        goes_left = binned[rows, f] <= b
        feature[at], limit[at], value[at] = f, edges[f][b], 0.0
        left[at] = grow(rows[goes_left], g, h, level + 1)
        right[at] = grow(rows[~goes_left], g, h, level + 1)
        return at

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0))
        tree = Forest(np.array(roots[-1:]), *(np.array(c) for c in (feature, limit, left, right, value)), 0.0, depth)
        node = np.full(n, roots[-1])
        for _ in range(depth):
            node = np.where(x[np.arange(n), tree.feature[node]] > tree.limit[node], tree.right[node], tree.left[node])
        margin += tree.value[node]
    if not roots:
        roots.append(leaf(0.0))
    return Forest(np.array(roots), *(np.array(c) for c in (feature, limit, left, right, value)), base, depth)
