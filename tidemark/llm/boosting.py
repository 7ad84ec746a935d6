"""Gradient-boosted trees over dense features, and isotonic calibration, in arrays.

Small by design: a model is fitted on a bounded sample and is a few kilobytes,
so it travels to executors inside the job.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic gradient boosting with histograms; ``depth`` levels a tree."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 4, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        self.edges = [np.unique(np.concatenate([e, [0.0]])) if x[:, j].min() <= 0 < x[:, j].max() else e for j, e in enumerate(self.edges)]
        width = max(len(e) for e in self.edges) + 1
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        flat = b + np.arange(k) * width
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            size = 2**self.depth
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(2 * size)
            node = np.ones(n, np.int64)
            for level in range(self.depth):
                for at in range(2**level, 2 ** (level + 1)):
                    rows = np.nonzero(node == at)[0]
                    if len(rows) < 2 * self.least:
                        continue
                    idx = flat[rows].ravel()
                    hist = [np.bincount(idx, np.repeat(v, k), k * width).reshape(k, width).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                    gl, hl, nl = hist
                    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(nl < self.least) | (nt - nl < self.least)] = 0
                    j, c = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, c] <= 1e-9 or c >= len(self.edges[j]):
                        continue
                    feature[at], cut[at] = j, self.edges[j][c]
                    node[rows] = 2 * at + (b[rows, j] > c)
            for leaf in np.unique(node):
                rows = node == leaf
                value[leaf] = self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
            f += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                inner = node < len(feature)
                at = np.where(inner, node, 0)
                j = np.where(inner, feature[at], -1)
                go = 2 * node + (x[np.arange(len(x)), np.maximum(j, 0)] > cut[at])
                node = np.where(j >= 0, go, node)
            f += value[node]
        return f


class Isotonic:
    """Monotone map from margins to probabilities, by pooling adjacent violators; linear between the pools."""

    def fit(self, f: np.ndarray, y: np.ndarray, weight: float = 1.0) -> Isotonic:
        order = np.argsort(f, kind="stable")
        pools: list[list[float]] = []  # sum of y, rows, sum of f
        for a, b in zip(f[order], y[order]):
            pools.append([float(b), 1.0, float(a)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], s)]
        prior = float(y.mean()) if len(y) else 0.0
        self.x = np.array([p[2] / p[1] for p in pools]) if pools else np.zeros(1)
        self.y = np.array([(p[0] + weight * prior) / (p[1] + weight) for p in pools]) if pools else np.zeros(1)
        self.y = np.maximum.accumulate(self.y)
        return self

    def of(self, f: np.ndarray) -> np.ndarray:
        """Within the outer pools a trace of the margin keeps the order of documents."""
        p = np.interp(f, self.x, self.y)
        return np.clip(0.998 * p + 0.002 / (1 + np.exp(-f)), 0.0, 1.0)
