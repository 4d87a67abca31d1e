"""Gradient-boosted trees for a few thousand rows of features, fitted on the driver and applied in tasks."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow regression trees on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Full binary trees: node k has children 2k+1 and 2k+2; a node that gains nothing sends all rows left."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        rows = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, int), np.full(inner, self.bins + 1)
            node = np.zeros(len(y), int)
            for k in range(inner):
                own = np.flatnonzero(node == k)
                if len(own) > 1:
                    feature[k], cut[k] = self._split(rows[own], slope[own], curve[own])
                node[own] = 2 * k + 1 + (rows[own, feature[k]] > cut[k])
            leaf = node - inner
            top = np.bincount(leaf, slope, inner + 1)
            value = self.rate * top / (np.bincount(leaf, curve, inner + 1) + 1.0)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _split(self, rows: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[int, int]:
        best, found = 1e-6, (0, self.bins + 1)
        g, h = slope.sum(), curve.sum()
        for j in range(rows.shape[1]):
            left_g = np.cumsum(np.bincount(rows[:, j], slope, self.bins + 1))
            left_h = np.cumsum(np.bincount(rows[:, j], curve, self.bins + 1))
            count = np.cumsum(np.bincount(rows[:, j], minlength=self.bins + 1))
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(count < self.least) | (len(rows) - count < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, k)
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        rows = self._binned(x)
        margin = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, feature[node]] > cut[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))
