"""Gradient-boosted trees for two classes in numpy, for small training sets gathered by an operator."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, a row each: a feature and threshold per inner node, a value per leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Logistic loss, second-order gains, thresholds at up to ``bins`` quantiles of each feature; bins are at most 255."""
    n, inner = x.shape[1], 2**depth - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left").astype(np.uint8) for j, c in enumerate(cuts)])
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(base / (1 - base)))
    score = np.full(len(x), start)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain = np.zeros(width)
            for j in range(n):
                if len(cuts[j]):
                    key, size = (node - first) * (bins + 1) + coded[j], width * (bins + 1)
                    left_g = np.bincount(key, g, size).reshape(width, -1).cumsum(1)
                    left_h = np.bincount(key, h, size).reshape(width, -1).cumsum(1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    better = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                    at = better[:, : len(cuts[j])].argmax(1)
                    found = better[np.arange(width), at]
                    wins = found > gain + 1e-9
                    gain[wins] = found[wins]
                    feature[first : first + width][wins] = j
                    threshold[first : first + width][wins] = cuts[j][at[wins]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(start, *(np.array([t[i] for t in trees]) for i in range(3)))
