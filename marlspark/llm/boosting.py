"""Gradient-boosted trees on a bounded sample of rows: logistic loss, binned features, small trees."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of depth ``depth``, each fitted to the gradient of the logistic loss and added with a small weight."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        value = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-value))
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            value += self._walk(tree, x)
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
        size = (1 << (self.depth + 1)) - 1
        feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(gradient))}
        for node in range(size):
            at = rows.pop(node, None)
            if at is None:
                continue
            g, w = gradient[at], weight[at]
            leaf[node] = self.rate * g.sum() / (w.sum() + 1.0)
            if 2 * node + 2 >= size or len(at) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            whole = g.sum() ** 2 / (w.sum() + 1.0)
            for j, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                b = binned[at, j]
                lg, lw, ln = (np.cumsum(np.bincount(b, v, len(edges) + 1))[:-1] for v in (g, w, np.ones(len(at))))
                rg, rw = g.sum() - lg, w.sum() - lw
                gain = np.where((ln >= self.least) & (len(at) - ln >= self.least), lg**2 / (lw + 1) + rg**2 / (rw + 1) - whole, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], self.edges[best[1]][best[2]]
                left = binned[at, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, leaf

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return leaf[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        value = np.full(len(x), self.start)
        for tree in self.trees:
            value += self._walk(tree, x)
        return 1 / (1 + np.exp(-value))
