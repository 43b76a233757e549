"""Gradient-boosted regression trees for the logistic loss, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass
class Boosted:
    """Full binary trees of one depth: feature and upper bound of each inner node in level order, value of each leaf."""

    base: float
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    place: np.ndarray | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, dense: int, trees: int = 60, depth: int = 5, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0) -> Boosted:
    """Second-order boosting on the logistic loss. The first ``dense`` columns are binned: each level's splits come from
    one histogram of gradients over node, feature and bin. The others are 0 or 1: their sums come from one product."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(dense)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    flags = np.ascontiguousarray(x[:, dense:].T == 0, np.float64)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    out = np.full(n, base)
    features, bounds, values = [], [], []
    offset = np.arange(dense) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, p * (1 - p)
        f, b, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = (((at - first) * (dense * BINS))[:, None] + offset + binned).ravel()
            sums = lambda v: np.bincount(key, np.repeat(v, dense), width * dense * BINS).reshape(width, dense, BINS).cumsum(2)  # noqa: B023, E731
            node = np.zeros((n, width))
            node[np.arange(n), at - first] = 1
            low = lambda v: np.concatenate([sums(v).reshape(width, -1), (flags @ (node * v[:, None])).T], 1)  # noqa: B023, E731
            gs, hs = low(g), low(h)
            gt, ht = (g @ node)[:, None], (h @ node)[:, None]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least / 10) | (ht - hs < least / 10)] = -1
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(width), best] > 1e-6):
                j, c = divmod(int(best[k]), BINS)
                if best[k] >= dense * BINS:
                    f[first + k], b[first + k] = best[k] - dense * BINS + dense, 0.5
                elif c < len(cuts[j]):
                    f[first + k], b[first + k] = j, cuts[j][c]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > b[at])
        leaf = at - (2**depth - 1)
        v = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        out += v[leaf]
        features.append(f)
        bounds.append(b)
        values.append(v)
    return Boosted(base, np.array(features), np.array(bounds), np.array(values))
