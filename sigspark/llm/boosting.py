"""Gradient-boosted regression trees for two classes, over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: split features and values by level order, and leaf values."""

    depth: int
    start: float
    feature: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, v, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > v[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 2.0, bins: int = 32) -> Trees:
    """Newton steps on the logistic loss; splits at quantiles of the features."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    z = np.full(n, model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, curve = y - p, p * (1 - p)
        feature, value = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            g, h = np.zeros((m, width, bins)), np.zeros((m, width, bins))
            for j in range(m):
                at = (node - first) * bins + code[:, j]
                g[j] = np.bincount(at, grad, minlength=width * bins).reshape(width, bins)
                h[j] = np.bincount(at, curve, minlength=width * bins).reshape(width, bins)
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
            for k in range(width):
                best = int(gain[:, k].argmax())
                j, b = divmod(best, bins)
                if gain[j, k, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], value[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > value[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, grad, minlength=2**depth) / (np.bincount(at, curve, minlength=2**depth) + penalty)
        z += leaf[at]
        model.feature.append(feature)
        model.value.append(value)
        model.leaf.append(leaf)
    return model
