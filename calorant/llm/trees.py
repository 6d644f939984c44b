"""Gradient-boosted trees and isotonic calibration for bounded samples of dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays: of each inner node a feature and a cut, of each leaf a value; a start value."""

    start: float
    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (1 << self.depth) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, penalty: float = 1.0) -> Boosted:
    """Logistic boosting over quantile bins; nodes split where the second-order gain is largest."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    margin, inner, outer = np.full(len(y), start), (1 << depth) - 1, 1 << depth
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) >= 20:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    left_g = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
                    gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, e[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, outer) / (np.bincount(leaf, h, outer) + penalty)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Boosted(start, depth, np.array(features), np.array(cuts), np.array(leaves))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, by pooling adjacent violators; equal x pool first."""
    values, index = np.unique(x, return_inverse=True)
    weight = np.bincount(index).astype(float)
    pools: list[list[float]] = []
    for k, (v, w) in enumerate(zip(np.bincount(index, y) / weight, weight)):
        pools.append([v, w, values[k], values[k]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, _, high = pools.pop()
            v1, w1, low, _ = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, low, high])
    knots = [(x, p[0]) for p in pools for x in ([p[2], p[3]] if p[2] < p[3] else [p[2]])]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
