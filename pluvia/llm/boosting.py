"""Gradient-boosted trees for a few thousand rows: logistic loss, quantile bins, trees of a fixed depth.

Fitting takes place on the driver over a bounded sample; executors only score Arrow batches with the few arrays of
:class:`Trees`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature and cut of the inner nodes (heap order) and values of the leaves, a row per tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def parts(self) -> tuple:
        return self.base, self.feature, self.cut, self.leaf


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    rows, columns = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(rows, base)
    inner = 2**depth - 1
    out = [np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))]
    offset = np.arange(columns) * bins
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            nodes = 2**level
            cell = ((at - first)[:, None] * (columns * bins) + offset + binned).ravel()
            size = nodes * columns * bins
            g = np.bincount(cell, np.repeat(grad, columns), size).reshape(nodes, columns, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(hess, columns), size).reshape(nodes, columns, bins).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            best = gain.reshape(nodes, -1).argmax(1)
            for node in range(nodes):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-9 and b < len(edges[j]):
                    out[0][k, first + node], out[1][k, first + node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(rows), out[0][k, at]] > out[1][k, at])
        leaf = at - inner
        value = np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge) * rate
        out[2][k] = value
        margin += value[leaf]
    return Trees(base, *out)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 25) -> tuple[float, float]:
    """Slope and offset that turn margins of held-out rows into calibrated log odds."""
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, x.T @ (p - target))
    return float(w[0]), float(w[1])


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold from which on held-out precision is reached; above 1 if it never is."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.nonzero(right >= precision)[0]
    return float(probability[order][good[-1]]) if len(good) else 1.1
