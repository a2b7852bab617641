"""Gradient-boosted trees for two classes, small enough to ship with a task.

Features are cut into at most ``bins`` quantile bins; trees of fixed depth are grown level by level from
histograms of gradient and curvature of the logistic loss.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """fit() then score(); scores are log-odds."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.shrink = rounds, depth, rate, bins, shrink
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        binned, total = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(total)
            tree = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            total += self.rate * self._leaf(binned, tree)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 1 << 30)
        node, width = np.zeros(len(g), np.int64), self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for f in range(binned.shape[1]):
                at = (node - first) * width + binned[:, f]
                left_g, left_h = (np.bincount(at, w, count * width).reshape(count, width).cumsum(1) for w in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                value = lambda a, b: a * a / (b + self.shrink)
                gain = value(left_g, left_h) + value(all_g - left_g, all_h - left_h) - value(all_g, all_h)
                gain[:, -1] = 0
                top = gain.argmax(1)
                better = gain[np.arange(count), top] > best
                best = np.where(better, gain[np.arange(count), top], best)
                feature[first : first + count][better] = f
                cut[first : first + count][better] = top[better]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        leaves = 2**self.depth
        return feature, cut, -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.shrink)

    def _leaf(self, binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, total = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            total += self.rate * self._leaf(binned, tree)
        return total


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is the share of positives; Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * score).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        hess = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
