"""Gradient-boosted trees with a logistic loss over dense features, and isotonic calibration.

Small and dependency-free: it fits on the driver over a bounded sample, and scores in numpy
on the executors.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features; targets may be shares between 0 and 1."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 10.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base = 0.0
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, cut, leaf value of a full tree

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        share = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4)) if n else 0.5
        self.base = float(np.log(share / (1 - share)))
        # half the cuts by rank, half among the positives' ranks, which are few
        pos = x[y > 0.5] if (y > 0.5).any() else x
        q = np.linspace(0, 1, self.bins // 2 + 1)[1:-1]
        self.cuts = [np.unique(np.concatenate([np.quantile(x[:, j], q), np.quantile(pos[:, j], q)])) if n else np.array([]) for j in range(m)]
        b = self._binned(x) if n else np.zeros((0, m), dtype=np.int16)
        f = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        bins = max([len(c) for c in self.cuts], default=0) + 1
        cell = (b + np.arange(m, dtype=np.int64) * bins).ravel()  # feature and bin of every value, row by row
        last = np.array([len(c) for c in self.cuts])
        open_cut = np.arange(bins)[None, :] < last[:, None]  # bins that a feature can be cut after
        for _ in range(self.rounds if n else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
            gs, hs = np.repeat(g, m), np.repeat(h, m)
            feature, cut = np.full(inner, -1), np.zeros(inner)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                at = np.repeat((node - first) * (m * bins), m) + cell
                size = width * m * bins
                sums = [np.cumsum(np.bincount(at, x, size).reshape(width, m, bins), axis=2) for x in (gs, hs, None)]
                choice, place = self._cuts_of(*sums, open_cut)
                for k in range(width):
                    if choice[k] >= 0:
                        feature[first + k], cut[first + k] = choice[k], self.cuts[choice[k]][place[k]]
                own, put = choice[node - first], place[node - first]
                right = (own >= 0) & (b[np.arange(n), np.maximum(own, 0)] > put)
                node = 2 * node + 1 + right
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.ridge)
            f += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _cuts_of(self, g: np.ndarray, h: np.ndarray, count: np.ndarray, open_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best feature and bin to cut each node after, -1 where none gains; running sums by node, feature and bin."""
        tg, th, tn = g[:, :1, -1:], h[:, :1, -1:], count[:, :1, -1:]
        gain = g**2 / (h + self.ridge) + (tg - g) ** 2 / (th - h + self.ridge) - tg**2 / (th + self.ridge)
        gain = np.where(open_cut[None] & (count >= self.least) & (tn - count >= self.least), gain, -1.0).reshape(len(g), -1)
        best = gain.argmax(axis=1)
        found = gain[np.arange(len(g)), best] > 1e-6
        return np.where(found, best // g.shape[2], -1), best % g.shape[2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = feature[node]
                right = (j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > cut[node])
                node = 2 * node + 1 + right
            f += value[node - (2**self.depth - 1)]
        return f


class Isotonic:
    """Non-decreasing step function by pooling adjacent violators, linear between steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # weight, sum, sum of x
        for a, b, c in zip(x[order], y[order], w[order], strict=True):
            blocks.append([c, b * c, a * c])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        self.at = np.array([s / c for c, _, s in blocks]) if blocks else np.array([0.0])
        self.value = np.array([s / c for c, s, _ in blocks]) if blocks else np.array([0.0])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)
