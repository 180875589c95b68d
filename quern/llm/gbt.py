"""Gradient-boosted trees for two classes, on numpy alone.

Training bins every feature at quantiles and grows each tree level by level
from histograms of gradients. A feature may be bound to rise (1) or fall (-1)
with the score: a split against the bound is refused, and both sides keep to
their side of the split's midpoint below it. The trees are flattened into node
arrays, and scoring walks all trees and all rows at once, one level a step.
"""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Model:
    """Node arrays of all trees; a leaf points at itself. base is the score before any tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray, block: int = 8192) -> np.ndarray:
        """Log odds of the positive class for each row of x; a NaN goes left."""
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), block):
            part = x[lo : lo + block]
            at = np.tile(self.roots, (len(part), 1))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] > self.threshold[at], self.right[at], self.left[at])
            out[lo : lo + block] += self.value[at].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -50, 50)))


def constant(p: float) -> Model:
    """A model without trees."""
    p = min(max(p, 1e-9), 1 - 1e-9)
    leaf = np.zeros(1, np.int64)
    return Model(float(np.log(p / (1 - p))), leaf, leaf, np.full(1, np.inf), leaf, leaf, np.zeros(1), 0)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 10.0, l2: float = 1.0) -> Model:
    """A model of P(y = 1 | x). No rows, or one class only, give a constant model."""
    n, f = x.shape
    if n == 0 or y.min() == y.max():
        return constant(1.0 if n == 0 else float(y.mean()))
    monotone = np.zeros(f, int) if monotone is None else np.asarray(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    flat = binned + np.arange(f) * width
    y = y.astype(float)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def node(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = node(0.0)
        roots.append(root)
        level = [(root, np.arange(n), -np.inf, np.inf)]
        for d in range(depth + 1):
            below = []
            for k, rows, low, high in level:
                sg, sh = g[rows].sum(), h[rows].sum()
                nodes["value"][k] = rate * float(np.clip(sg / (sh + l2), low, high))
                score[rows] += nodes["value"][k] if d == depth else 0
                if d == depth:
                    continue
                cell = flat[rows].ravel()
                hg = np.bincount(cell, np.repeat(g[rows], f), f * width).reshape(f, width).cumsum(1)
                hh = np.bincount(cell, np.repeat(h[rows], f), f * width).reshape(f, width).cumsum(1)
                hn = np.bincount(cell, minlength=f * width).reshape(f, width).cumsum(1)
                vl, vr = np.clip(hg / (hh + l2), low, high), np.clip((sg - hg) / (sh - hh + l2), low, high)
                gain = 2 * (vl * hg + vr * (sg - hg)) - vl**2 * (hh + l2) - vr**2 * (sh - hh + l2) - sg**2 / (sh + l2)
                bad = (hn < least) | (len(rows) - hn < least) | (monotone[:, None] * (vr - vl) < 0)
                gain[bad] = -np.inf
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if not gain[j, b] > 1e-6 or b >= len(cuts[j]):
                    score[rows] += nodes["value"][k]
                    continue
                a, c = node(0.0), node(0.0)
                nodes["feature"][k], nodes["threshold"][k], nodes["left"][k], nodes["right"][k] = int(j), float(cuts[j][b]), a, c
                goes = binned[rows, j] <= b
                middle = (vl[j, b] + vr[j, b]) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[j])]
                below += [(a, rows[goes], *bounds[0]), (c, rows[~goes], *bounds[1])]
            level = below
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return Model(base, np.array(roots), arrays["feature"], arrays["threshold"], arrays["left"], arrays["right"], arrays["value"], depth)
