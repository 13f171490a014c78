"""Gradient-boosted trees for two classes, on numpy: logistic loss, binned features."""

from __future__ import annotations

import numpy as np

from weftgraph.llm._base import sigmoid


class Boost:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 4.0, bins: int = 24):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = sigmoid(z)
            g, h = y - q, q * (1 - q)
            tree, leaf = self._tree(b, g, h)
            self.trees.append(tree)
            z += tree[2][leaf]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full binary tree as arrays: split feature, split bin (go right above it), value of each node."""
        n = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(n, -1), np.zeros(n, dtype=int), np.zeros(n)
        at = np.zeros(len(g), dtype=int)
        for node in range(n):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            sg, sh = g[rows].sum(), h[rows].sum()
            value[node] = self.rate * sg / (sh + 1.0)
            if node >= n // 2:
                continue
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]):
                k = len(self.edges[f]) + 1
                if k == 1:
                    continue
                gl, hl = (np.bincount(b[rows, f], v[rows], k).cumsum()[:-1] for v in (g, h))
                gain = gl**2 / (hl + 1.0) + (sg - gl) ** 2 / (sh - hl + 1.0) - sg**2 / (sh + 1.0)
                gain[(hl < self.least / 4) | (sh - hl < self.least / 4)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), f, i)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                right = b[rows, best[1]] > best[2]
                at[rows] = 2 * node + 1 + right
        return (feature, cut, value), at

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        z = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[at]
                go = 2 * at + 1 + (b[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(f >= 0, go, at)
            z += value[at]
        return z
