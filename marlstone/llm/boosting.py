"""Gradient-boosted trees on binned features with logistic loss, and isotonic calibration; numpy only.

Meant for a bounded sample on the driver: a few ten thousand rows by some ten features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """A fitted ensemble: per tree arrays of feature, threshold and value in heap order."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                go = x[rows, f[node]] > t[node]
                node = 2 * node + 1 + go
            out += v[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 4.0, bins: int = 32) -> Trees:
    """Newton boosting with exact gains over quantile bins."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    cuts = [np.unique(np.concatenate([c, np.unique(x[:, j])[:bins]])) for j, c in enumerate(cuts)]
    width = max(len(c) for c in cuts) + 1
    b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = np.clip((weight @ y) / weight.sum(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p0 / (1 - p0))), depth)
    margin = np.full(n, model.base)
    cols = np.arange(d) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, threshold, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(2**depth)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) >= 8:
                    flat = (b[at] + cols).ravel()
                    gs = np.bincount(flat, np.repeat(g[at], d), d * width).reshape(d, width).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[at], d), d * width).reshape(d, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    gain[(hs < 0.3) | (ht - hs < 0.3)] = -1
                    j, c = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, c] > 1e-6 and c < len(cuts[j]):
                        feature[k], threshold[k] = j, cuts[j][c]
                node[at] = 2 * k + 1 + (x[at, feature[k]] > threshold[k])
        leaf = node - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        value = rate * gs / (hs + l2)
        model.feature.append(feature[: 2**depth - 1])
        model.threshold.append(threshold[: 2**depth - 1])
        model.value.append(value)
        margin += value[leaf]
    return model


@dataclass
class Isotonic:
    """A rising step function, read off by interpolation."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return np.interp(m, self.x, self.y)


def isotonic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool adjacent violators over margins."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []  # weighted mean, weight, lowest and highest margin
    for i in order:
        blocks.append([float(y[i]), float(weight[i]), float(m[i]), float(m[i])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    xs, ys = [], []
    for v, _, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return Isotonic(np.array(xs), np.array(ys))
