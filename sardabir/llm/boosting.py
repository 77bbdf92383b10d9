"""Gradient-boosted trees for two classes, in numpy: histograms of binned features, trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: per tree, features and cuts of 2**depth - 1 nodes and values of 2**depth leaves."""

    depth: int
    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base, np.float64), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Fits trees to labels 0 and 1 by logistic loss with second-order leaves."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    logit = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, leaves = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, np.float64), (inner + 1, np.float64)))
    cuts[:] = np.inf
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        slope, curve = y - p, p * (1 - p) + 1e-9
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * width + np.arange(width)) * bins + binned
            g = np.bincount(cell.ravel(), weights=np.repeat(slope, width), minlength=count * width * bins).reshape(count, width, bins)
            h = np.bincount(cell.ravel(), weights=np.repeat(curve, width), minlength=count * width * bins).reshape(count, width, bins)
            left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            all_g, all_h = g.sum(axis=2)[:, :1, None], h.sum(axis=2)[:, :1, None]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    features[t, first + k], cuts[t, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), features[t][at]] > cuts[t][at])
        leaf = at - inner
        value = np.bincount(leaf, weights=slope, minlength=inner + 1) / (np.bincount(leaf, weights=curve, minlength=inner + 1) + ridge)
        leaves[t] = rate * value
        logit += leaves[t][leaf]
    return Trees(depth, base, features, cuts, leaves)
