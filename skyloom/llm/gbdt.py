"""Gradient-boosted regression trees in numpy: histogram training, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays; tree *k* starts at ``roots[k]``, a leaf has ``feature`` -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row: all trees advance one level at a time for a whole block of rows."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    min_rows: int = 10,
) -> Forest:
    """Boost logistic loss.  ``monotone[j]`` is +1, -1 or 0 for feature *j*.

    A split on a constrained feature is taken only when its children keep the order, and
    both subtrees are then bounded by the midpoint of the children's values, so the whole
    forest is monotone.  With one class (or no rows) the forest is a constant.
    """
    n, width = x.shape if x.ndim == 2 else (0, len(monotone))
    rate_pos = (float(y.sum()) + 1.0) / (n + 2.0)
    bias = float(np.log(rate_pos / (1 - rate_pos)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
        score = np.full(n, bias)

        def leaf(value: float) -> int:
            nodes.append([-1, 0.0, -1, -1, value])
            return len(nodes) - 1

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            here = float(np.clip(-total_g / (total_h + l2), low, high))
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * min_rows:
                for j in range(width):
                    size = len(cuts[j]) + 1
                    if size < 2:
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    vl = np.clip(-gl / (hl + l2), low, high)
                    vr = np.clip(-(total_g - gl) / (total_h - hl + l2), low, high)
                    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((total_g - gl) * vr + 0.5 * (total_h - hl + l2) * vr**2)
                    gain += total_g * here + 0.5 * (total_h + l2) * here**2
                    ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
                    if monotone[j]:
                        ok &= monotone[j] * (vr - vl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            if best[1] < 0:
                return leaf(rate * here)
            _, j, k, vl, vr = best
            mid = 0.5 * (vl + vr)
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            at = leaf(0.0)
            goes = binned[rows, j] <= k
            a = grow(rows[goes], g, h, level + 1, *bounds[0])
            b = grow(rows[~goes], g, h, level + 1, *bounds[1])
            nodes[at] = [j, float(cuts[j][k]), a, b, 0.0]
            return at

        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-score))
            root = grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf)
            roots.append(root)
            t = np.array(nodes)
            node = np.full(n, root)
            for _ in range(depth):
                f = t[node, 0].astype(int)
                left = x[np.arange(n), np.maximum(f, 0)] <= t[node, 1]
                node = np.where(f < 0, node, np.where(left, t[node, 2], t[node, 3]).astype(int))
            score = score + t[node, 4]
    t = np.array(nodes).reshape(-1, 5)
    return Forest(t[:, 0].astype(np.int32), t[:, 1], t[:, 2].astype(np.int32), t[:, 3].astype(np.int32), t[:, 4], np.array(roots, np.int64), depth, bias)
