"""Histogram gradient boosting for two classes in numpy, with trees flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node k has children 2k + 1 and 2k + 2. features, cuts: (trees, 2^depth - 1); a row
    goes right where its feature is above the cut. leaves: (trees, 2^depth)."""

    prior: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.features.shape[1]
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            total += leaves[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Forest:
    """penalty: on squared leaf values. least: of the second derivatives' sum that a child must have. One class only,
    or no rows, gives a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    total, found = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = (node - first) * bins
            best = np.full(n, 1e-9)
            chosen = np.full(n, -1)
            for f, codes in enumerate(binned):
                gs = np.bincount(at + codes, g, n * bins).reshape(n, bins).cumsum(1)
                hs = np.bincount(at + codes, h, n * bins).reshape(n, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(edges[f])]
                if gain.size:
                    k = gain.argmax(1)
                    value = gain[np.arange(n), k]
                    better = value > best
                    best[better], chosen[better] = value[better], k[better]
                    features[first : first + n][better], cuts[first : first + n][better] = f, edges[f][k[better]]
            right = x[np.arange(len(y)), features[node]] > cuts[node]
            node = 2 * node + 1 + right
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        total += values[leaf]
        found.append((features, cuts, values))
    return Forest(prior, *(np.stack([t[k] for t in found]) for k in range(3)))
