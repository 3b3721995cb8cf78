"""Gradient-boosted trees for a yes/no label on small dense tables: logistic loss, histogram splits, depth-wise growth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees in heap order: node i has children 2i + 1 and 2i + 2; a feature of -1 sends all to the left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > cut[node]))
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0, least: float = 5.0) -> Forest:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    flat = (binned + np.arange(width) * bins).astype(np.int64)
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + flat).reshape(-1)
            g, h = (np.bincount(at, np.repeat(w, width), k * width * bins).reshape(k, width, bins) for w in (grad, hess))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + i], threshold[first + i] = f, cuts[f][b]
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(n), f] > threshold[node]))
        own = node - inner
        leaf = rate * np.bincount(own, grad, 1 << depth) / (np.bincount(own, hess, 1 << depth) + ridge)
        margin += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)
