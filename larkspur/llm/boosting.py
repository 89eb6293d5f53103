"""Gradient-boosted trees for a few thousand rows: logistic loss, thresholds at quantiles."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.start = 0.0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # v <= cut[k] where code <= k
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            feature, cut, leaf = self._tree(code, cuts, p - y, p * (1 - p))
            self.model.append((feature, cut, leaf))
            f += self._one(x, feature, cut, leaf)
        return self

    def _tree(self, code, cuts, g, h):
        nodes = (1 << self.depth) - 1
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        at = np.zeros(len(g), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            best = 1e-9
            for j, c in enumerate(cuts):
                gs = np.bincount(code[rows, j], g[rows], len(c) + 1).cumsum()
                hs = np.bincount(code[rows, j], h[rows], len(c) + 1).cumsum()
                gain = gs**2 / (hs + self.l2) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.l2) - gs[-1] ** 2 / (hs[-1] + self.l2)
                k = int(np.argmax(gain[:-1])) if len(c) else 0
                if len(c) and gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, c[k]
            if np.isinf(cut[node]):
                at[rows] = 2 * node + 1
            else:
                at[rows] = 2 * node + 1 + (code[rows, feature[node]] > np.searchsorted(cuts[feature[node]], cut[node]))
        leaf = at - nodes
        n = 1 << self.depth
        return feature, cut, -self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.l2)

    def _one(self, x, feature, cut, leaf):
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return leaf[at - len(feature)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for feature, cut, leaf in self.model:
            f += self._one(x, feature, cut, leaf)
        return 1 / (1 + np.exp(-f))
