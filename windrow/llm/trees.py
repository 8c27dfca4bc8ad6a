"""Gradient-boosted trees for two classes, kept as flat node arrays.

Histogram splits with a logistic loss. A monotonic constraint on a feature (+1 or -1) refuses splits against
its direction and hands the middle of the two leaf values down as a bound, so that the whole ensemble is
monotonic in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays: node i goes left when x[feature[i]] <= threshold[i]; leaves have feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                goes = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    l2: float = 2.0,
    least: float = 4.0,
) -> Forest:
    """Fit on a bounded sample. Without rows, or with one class, the forest is a constant."""
    monotone = monotone or {}
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value)):
            nodes[k].append(v)
        return len(nodes["feature"]) - 1

    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            leaf = lambda gs, hs, lo, hi: float(np.clip(-gs / (hs + l2), lo, hi))
            root = add(leaf(g.sum(), h.sum(), -np.inf, np.inf) * rate)
            roots.append(root)
            front = [(root, np.arange(len(y)), -np.inf, np.inf)]
            where = np.full(len(y), root)
            for _level in range(depth):
                following = []
                for node, rows, lo, hi in front:
                    best = (1e-6, -1, 0, 0.0, 0.0)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        c = code[rows, j]
                        gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                        gr, hr = gs - gl, hs - hl
                        vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                        bad = (hl < least / 4) | (hr < least / 4)
                        if sign := monotone.get(j, 0):
                            bad |= sign * (vr - vl) < 0
                        gain = np.where(bad, -np.inf, gain)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
                    _, j, k, vl, vr = best
                    if j < 0:
                        continue
                    goes = code[rows, j] <= k
                    a, b = add(vl * rate), add(vr * rate)
                    nodes["feature"][node], nodes["threshold"][node] = j, float(edges[j][k])
                    nodes["left"][node], nodes["right"][node] = a, b
                    where[rows[goes]], where[rows[~goes]] = a, b
                    mid, sign = (vl + vr) / 2, monotone.get(j, 0)
                    low = (lo, mid) if sign > 0 else (mid, hi) if sign < 0 else (lo, hi)
                    high = (mid, hi) if sign > 0 else (lo, mid) if sign < 0 else (lo, hi)
                    following += [(a, rows[goes], *low), (b, rows[~goes], *high)]
                front = following
            score += np.array(nodes["value"])[where]
    return Forest(
        np.array(roots, np.int64),
        np.array(nodes["feature"] or [-1], np.int64),
        np.array(nodes["threshold"] or [0.0]),
        np.array(nodes["left"] or [-1], np.int64),
        np.array(nodes["right"] or [-1], np.int64),
        np.array(nodes["value"] or [0.0]),
        depth,
        bias,
    )
