"""A small gradient-boosted classifier in numpy: logistic loss, depth-limited trees over quantile bins.

Meant for a bounded training sample on the driver and for prediction inside Arrow batches; deterministic.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, min_leaf: int = 5, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.min_leaf, self.ridge = trees, depth, rate, bins, min_leaf, ridge
        self.base, self.forest = 0.0, []

    def _split(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray):
        """The cut with most gain among the edges of every feature, or None."""
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, f], side="left")
            gs, hs, ns = (np.cumsum(np.bincount(at, w, len(edges) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
            gain[(ns < self.min_leaf) | (len(rows) - ns < self.min_leaf)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, edges[k])
        return best[1:] if best[1] is not None else None

    def _grow(self, x, grad, hess, rows, depth):
        cut = self._split(x, grad, hess, rows) if depth and len(rows) >= 2 * self.min_leaf else None
        if cut is None:
            return -self.rate * grad[rows].sum() / (hess[rows].sum() + self.ridge)
        left = x[rows, cut[0]] <= cut[1]
        return (*cut, self._grow(x, grad, hess, rows[left], depth - 1), self._grow(x, grad, hess, rows[~left], depth - 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """``x`` (rows, features) without NaN, ``y`` 0 or 1. No rows, or one class alone, give a constant."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.forest = float(np.log(p / (1 - p))), []
        if len(y) == 0 or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for f in range(x.shape[1])]
        self.edges = [e[e < x[:, f].max()] for f, e in enumerate(self.edges)]
        score, every = np.full(len(y), self.base), np.arange(len(y))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, p - y, p * (1 - p), every, self.depth)
            self.forest.append(tree)
            score += self._walk(tree, x)
        return self

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for tree in self.forest:
            score += self._walk(tree, x)
        return 1 / (1 + np.exp(-score))

    def decide(self, x: list[float]) -> bool:
        """Whether one row's probability is a half or more, without arrays."""
        score = self.base
        for tree in self.forest:
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            score += tree
        return score >= 0
