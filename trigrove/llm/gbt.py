"""Gradient-boosted binary trees with logistic loss over binned features, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    feature: np.ndarray  # trees x inner nodes, heap order
    cut: np.ndarray  # goes right where the value exceeds it
    leaf: np.ndarray  # trees x leaves
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        every = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[every, feature[at]] > cut[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, shrink: float = 1.0, share: float = 0.4) -> Trees:
    """Newton boosting on ``x`` (rows x features) and labels 0 or 1; a tree's cuts are chosen on a share of the rows."""
    draw = np.random.default_rng(0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(len(y), prior)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        drawn = draw.random(len(y)) < share
        for node in range(inner):
            every = np.flatnonzero(at == node)
            own = every[drawn[every]]
            if not len(own):
                at[every] = 2 * node + 1
                continue
            keys = flat[own].ravel()
            gs = np.bincount(keys, np.repeat(g[own], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
            hs = np.bincount(keys, np.repeat(h[own], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + shrink) + (gt - gs) ** 2 / (ht - hs + shrink) - gt**2 / (ht + shrink)
            gain[:, -1] = -1
            gain[(hs < 0.5) | (ht - hs < 0.5)] = -1
            f, b = divmod(int(gain.argmax()), width)
            if gain[f, b] > 1e-3 and b < len(edges[f]):
                features[t, node], cuts[t, node] = f, edges[f][b]
            at[every] = 2 * node + 1 + (x[every, features[t, node]] > cuts[t, node])
        place = at - inner
        values[t] = -rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + shrink)
        z += values[t][place]
    return Trees(features, cuts, values, prior)
