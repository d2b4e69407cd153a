"""Small gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss, Newton leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``depth`` levels; node i of a tree has children 2i + 1 and 2i + 2; leaves hold log-odds steps."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Boost ``n_trees`` trees on rows ``x`` with labels ``y`` of 0 and 1."""
    w = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    p0 = float(np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3))
    score = np.full(len(y), np.log(p0 / (1 - p0)))
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 8:
                    gs, hs = g[rows], h[rows]
                    total_g, total_h = gs.sum(), hs.sum()
                    own = total_g**2 / (total_h + ridge)
                    for f in range(x.shape[1]):
                        if not len(edges[f]):
                            continue
                        b = binned[rows, f]
                        lg = np.cumsum(np.bincount(b, gs, len(edges[f]) + 1))[:-1]
                        lh = np.cumsum(np.bincount(b, hs, len(edges[f]) + 1))[:-1]
                        gain = lg**2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge) - own
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), f, float(edges[f][i]))
                feature[t, node], cut[t, node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        for k in range(inner + 1):
            rows = at == inner + k
            leaf[t, k] = rate * g[rows].sum() / (h[rows].sum() + ridge)
        score += leaf[t][at - inner]
    return Trees(float(np.log(p0 / (1 - p0))), depth, feature, cut, leaf)
