"""Gradient-boosted trees on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth; leaves add to the log odds."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    l2: float = 2.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        share = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(m)], 1)
        odds = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == k)
                    best = self._split(binned[rows], g[rows], h[rows], edges)
                    if best is not None:
                        feature[k], cut[k] = best[0], edges[best[0]][best[1]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] >= cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, cut, value))
            odds += value[leaf]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
        best, where = 1e-6, None
        if len(g) < 10:
            return None
        whole = g.sum() ** 2 / (h.sum() + self.l2)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            left_g = np.cumsum(np.bincount(binned[:, j], g, len(e) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, j], h, len(e) + 1))[:-1]
            gain = left_g**2 / (left_h + self.l2) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + self.l2) - whole
            gain[(left_h < 0.5) | (h.sum() - left_h < 0.5)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (j, k)
        return where

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


@dataclass
class Isotonic:
    """A rising map from log odds to probabilities, by pooling adjacent violators; linear between the pools' centres."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, odds: np.ndarray, y: np.ndarray) -> Isotonic:
        """Each pool has one more document of either label, in halves, so no probability is 0 or 1. No rows: the logistic curve."""
        if not len(odds) or y.min() == y.max():
            grid = np.linspace(-8, 8, 65)
            return cls(grid, 1 / (1 + np.exp(-grid)))
        o = np.argsort(odds, kind="stable")
        pools: list[list[float]] = []
        for a, b in zip(odds[o], y[o].astype(float), strict=True):
            pools.append([b, 1.0, a])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, n, total = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + total]
        share = y.mean()
        at = np.array([total / n for _, n, total in pools])
        value = np.array([(s + share) / (n + 1) for s, n, _ in pools])
        return cls(at, np.maximum.accumulate(value))

    def __call__(self, odds: np.ndarray) -> np.ndarray:
        """Beyond the outer pools, and a little everywhere, the logistic curve keeps the order of the scores."""
        return np.clip(0.98 * np.interp(odds, self.at, self.value) + 0.02 / (1 + np.exp(-odds)), 0, 1)
