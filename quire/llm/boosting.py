"""Histogram gradient-boosted trees on numpy, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth, node i having children 2i+1 and 2i+2.

    feature, cut: trees x inner nodes; a row goes right where its value exceeds the cut (inf: never).
    leaf: trees x leaves, in log odds; base is added to their sum.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        depth = (inner + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting over binned columns; deterministic. With one class or no rows: the prior alone (no rows: 0.5)."""
    inner = 2**depth - 1
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(prior / (1 - prior))))
    if len(y) < 2 * least or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    columns = x.shape[1]
    flat = binned + np.arange(columns) * bins  # one histogram over all columns
    margin = np.full(len(y), empty.base)
    out: list[list[np.ndarray]] = [[], [], []]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, feature, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (columns * bins) + flat).ravel()
            hist = [np.bincount(slot, np.repeat(w, columns), width * columns * bins).reshape(width, columns, bins) for w in (g, h, np.ones(len(y)))]
            left = [np.cumsum(a, 2) for a in hist]
            total = [a[:, :, -1:] for a in left]
            gain = sum(((gl**2) / (hl + ridge)) for gl, hl in ((left[0], left[1]), (total[0] - left[0], total[1] - left[1]))) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[2] < least) | (total[2] - left[2] < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node, k in enumerate(best):
                f, b = divmod(int(k), bins)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + node], cut[first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge)
        margin += leaf[at - inner]
        for store, made in zip(out, (feature, cut, leaf), strict=True):
            store.append(made)
    return Trees(np.stack(out[0]), np.stack(out[1]), np.stack(out[2]), empty.base)
