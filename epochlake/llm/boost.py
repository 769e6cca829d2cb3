"""Gradient boosting of shallow trees for logistic loss, on a small dense table."""

from __future__ import annotations

import numpy as np


def _split(x, g, h, rows, min_rows):
    """(gain, column, threshold) of the best split of rows, or None."""
    best = None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    base = total_g**2 / (total_h + 1.0)
    for c in range(x.shape[1]):
        order = rows[np.argsort(x[rows, c], kind="stable")]
        v = x[order, c]
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= min_rows) & (at <= len(order) - min_rows)]
        if not len(at):
            continue
        lg, lh = np.cumsum(g[order])[at - 1], np.cumsum(h[order])[at - 1]
        gain = lg**2 / (lh + 1.0) + (total_g - lg) ** 2 / (total_h - lh + 1.0) - base
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], c, (v[at[k] - 1] + v[at[k]]) / 2)
    return best


def _grow(x, g, h, rows, depth, min_rows):
    found = _split(x, g, h, rows, min_rows) if depth else None
    if found is None:
        return float(-g[rows].sum() / (h[rows].sum() + 1.0))
    _, c, t = found
    left = x[rows, c] <= t
    return (c, t, _grow(x, g, h, rows[left], depth - 1, min_rows), _grow(x, g, h, rows[~left], depth - 1, min_rows))


def _apply(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    c, t, low, high = tree
    return np.where(x[:, c] <= t, _apply(low, x), _apply(high, x))


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, min_rows: int = 5):
        self.rounds, self.depth, self.rate, self.min_rows = rounds, depth, rate, min_rows
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = _grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth, self.min_rows)
            self.trees.append(tree)
            f += self.rate * _apply(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * _apply(tree, x)
        return 1 / (1 + np.exp(-f))
