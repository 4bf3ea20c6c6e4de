"""Gradient-boosted trees for two classes in numpy, and the calibration of their scores."""

from __future__ import annotations

import numpy as np

BINS = 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Trees of fixed depth on binned features, each fitted to the gradient of the log loss with Newton leaf values."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 2.0):
        self.trees, self.depth, self.rate, self.smooth = trees, depth, rate, smooth
        self.edges: list[np.ndarray] = []
        self.fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.calibration = (1.0, 0.0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        bins = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = sigmoid(margin)
            tree = self._tree(bins, y - p, p * (1 - p))
            self.fitted.append(tree)
            margin += self._walk(tree, bins)
        return self

    def _tree(self, bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, leaf = np.zeros(inner, int), np.full(inner, BINS), np.zeros(inner + 1)
        node = np.zeros(len(bins), int)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = 1e-6
            if len(here) > 8:
                for f in range(bins.shape[1]):
                    g = np.bincount(bins[here, f], gradient[here], BINS + 1).cumsum()
                    h = np.bincount(bins[here, f], weight[here], BINS + 1).cumsum()
                    gain = g**2 / (h + self.smooth) + (g[-1] - g) ** 2 / (h[-1] - h + self.smooth) - g[-1] ** 2 / (h[-1] + self.smooth)
                    k = int(gain[:-1].argmax())
                    if gain[k] > best:
                        best, feature[at], cut[at] = gain[k], f, k
            node[here] = 2 * at + 1 + (bins[here, feature[at]] > cut[at])
        for k in range(inner + 1):
            here = node == inner + k
            leaf[k] = self.rate * gradient[here].sum() / (weight[here].sum() + self.smooth)
        return feature, cut, leaf

    def _walk(self, tree: tuple, bins: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(self.depth):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        return self.start + sum((self._walk(t, bins) for t in self.fitted), np.zeros(len(bins)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Scale and shift of the margin, by Newton steps on the log loss of rows that no tree has seen."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * m + b)
            w = p * (1 - p) + 1e-6
            gradient = np.array([((y - p) * m).sum() - 0.01 * (a - 1), (y - p).sum()])
            hessian = np.array([[(w * m * m).sum() + 0.01, (w * m).sum()], [(w * m).sum(), w.sum()]])
            step = np.linalg.solve(hessian + 1e-6 * np.eye(2), gradient)
            a, b = float(np.clip(a + step[0], 0.1, 5)), float(np.clip(b + step[1], -10, 10))
        self.calibration = (a, b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return sigmoid(a * self.margin(x) + b)
