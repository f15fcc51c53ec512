"""Histogram gradient-boosted trees for a yes/no target, flattened to numpy arrays.

Features are cut into quantile bins; each level of a tree adds up gradients and hessians per node, feature and bin in
one bincount. A feature may be monotone (+1 or -1): a split on it must order its children's values, and the children
inherit the midpoint as a bound, so the whole tree is monotone in it. All trees are one set of node arrays; scoring
walks every row through every tree one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray  # to the left if value <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def predict(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Probabilities of label 1; not-a-number goes left."""
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            part = x[a : a + block]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            for _ in range(self.depth):
                f = self.feature[at]
                goes_right = part[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, np.where(goes_right, self.right[at], self.left[at]))
            out[a : a + block] = 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(1), -50, 50)))
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Trees for labels ``y`` (0 or 1). Without rows of both labels, the model is the smoothed share of label 1."""
    n, m = x.shape
    y = y.astype(np.float64)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        sign = np.zeros(m)
        for k, v in (monotone or {}).items():
            sign[k] = v
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
        flat = binned + np.arange(m) * bins
        score = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            root = len(nodes)
            roots.append(root)
            nodes.append([-1, 0.0, 0, 0, 0.0])
            live = {root: (np.arange(n), -np.inf, np.inf)}
            for level in range(depth + 1):
                after = {}
                for node, (rows, low, high) in live.items():
                    gs, hs = g[rows].sum(), h[rows].sum()
                    nodes[node][4] = rate * float(np.clip(-gs / (hs + l2), low, high))
                    if level == depth or len(rows) < 2 * least:
                        continue
                    at = flat[rows].ravel()
                    gh, hh, ch = (np.bincount(at, np.repeat(v, m), m * bins).reshape(m, bins).cumsum(1)[:, :-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    vl, vr = np.clip(-gh / (hh + l2), low, high), np.clip(-(gs - gh) / (hs - hh + l2), low, high)
                    gain = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                    gain[(ch < least) | (len(rows) - ch < least) | (sign[:, None] * (vr - vl) < 0)] = 0
                    j, k = divmod(int(gain.argmax()), bins - 1)
                    if gain[j, k] <= 1e-9 or k >= len(edges[j]):
                        continue
                    goes_left = binned[rows, j] <= k
                    mid = (vl[j, k] + vr[j, k]) / 2
                    a, b = len(nodes), len(nodes) + 1
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    nodes[node][:4] = [j, float(edges[j][k]), a, b]
                    up = (low, mid) if sign[j] > 0 else (mid, high) if sign[j] < 0 else (low, high)
                    down = (mid, high) if sign[j] > 0 else (low, mid) if sign[j] < 0 else (low, high)
                    after[a], after[b] = (rows[goes_left], *up), (rows[~goes_left], *down)
                for node, (rows, _, _) in live.items():
                    if nodes[node][0] < 0:
                        score[rows] += nodes[node][4]
                live = after
                if not live:
                    break
    else:
        roots, nodes = [0], [[-1, 0.0, 0, 0, 0.0]]
    a = np.array(nodes)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), np.where(a[:, 0] < 0, a[:, 4], 0.0), np.array(roots, np.int32), base, depth)
