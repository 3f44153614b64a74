"""Gradient-boosted regression trees for a binary label, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-wise trees on the logistic loss. A tree is three arrays over its nodes in breadth-first order."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, penalty: float = 2.0, least: float = 4.0):
        self.n, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins)[1:-1])) for k in range(x.shape[1])]
        b, width = self.binned(x), self.bins + 1
        columns = np.ascontiguousarray(b.T)
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        score, features = np.full(len(y), self.base), x.shape[1]
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature = np.zeros((1 << self.depth) - 1, dtype=np.int64)
            cut = np.full((1 << self.depth) - 1, width, dtype=np.int64)  # all go left
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                cell = (at - first) * width
                gain = np.full((count, features, width), -np.inf)
                for k in range(features):
                    sums = [np.bincount(cell + columns[k], weights=w, minlength=count * width).reshape(count, width).cumsum(axis=1) for w in (g, h)]
                    gl, hl, gt, ht = sums[0], sums[1], sums[0][:, -1:], sums[1][:, -1:]
                    worth = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[:, k] = np.where((hl >= self.least) & (ht - hl >= self.least), worth, -np.inf)
                best = gain.reshape(count, -1).argmax(axis=1)
                top = gain.reshape(count, -1)[np.arange(count), best]
                split = top > 1e-9
                feature[first : first + count] = np.where(split, best // width, 0)
                cut[first : first + count] = np.where(split, best % width, width)
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - ((1 << self.depth) - 1)
            gs, hs = (np.bincount(leaf, weights=w, minlength=1 << self.depth) for w in (g, h))
            value = self.rate * gs / (hs + self.penalty)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        b = self.binned(x)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - ((1 << self.depth) - 1)]
        return out
