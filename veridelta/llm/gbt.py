"""Gradient-boosted regression trees for a binary label, on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Boosted trees of one depth, stored level by level (node k has 2k+1, 2k+2)."""

    def __init__(self, edges: list[np.ndarray], depth: int, base: float):
        self.edges, self.depth, self.base = edges, depth, base
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def place(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return node - (2**self.depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        out = np.full(len(x), self.base)
        if len(x):
            b = self.binned(x)
            for f, c, v in zip(self.feature, self.cut, self.leaf):
                out += v[self.place(b, f, c)]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, depth, float(np.log(share / (1 - share))))
    b = model.binned(x)
    n, d = b.shape
    wide = max(len(e) for e in edges) + 1
    cells = (np.arange(d) * wide)[None, :] + b
    score = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, wide)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.nonzero(node == k)[0]
                if len(rows) < 8:
                    continue
                flat = cells[rows].ravel()
                gs = np.bincount(flat, np.repeat(g[rows], d), d * wide).reshape(d, wide).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[rows], d), d * wide).reshape(d, wide).cumsum(1)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[k], cut[k] = divmod(best, wide)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
    return model
