"""Gradient-boosted regression trees for a 0/1 target, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # -1 in leaves
    cut: np.ndarray
    left: np.ndarray  # the right child follows it
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if len(inner) == 0:
                return self.value[at]
            node = at[inner]
            at[inner] = self.left[node] + (x[inner, f[inner]] > self.cut[node])


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, rate: float) -> tuple[Tree, np.ndarray]:
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    fitted = np.zeros(len(g))
    todo = [(0, np.arange(len(g)), 0)]
    while todo:
        node, rows, level = todo.pop()
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, edge in enumerate(edges):
                if len(edge) == 0:
                    continue
                code = codes[rows, f]
                bins = len(edge) + 1
                n = np.cumsum(np.bincount(code, minlength=bins))[:-1]
                lg = np.cumsum(np.bincount(code, g[rows], minlength=bins))[:-1]
                lh = np.cumsum(np.bincount(code, h[rows], minlength=bins))[:-1]
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            value[node] = rate * total_g / (total_h + 1)
            fitted[rows] = value[node]
            continue
        f, k = best[1]
        feature[node], cut[node], left[node] = f, float(edges[f][k]), len(feature)
        right = codes[rows, f] > k
        for part in (rows[~right], rows[right]):
            todo.append((len(feature), part, level + 1))
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value)), fitted


class Boosted:
    """Log-odds of the target as a sum of trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 4, rate: float = 0.25, least: int = 15) -> None:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 18)[1:-1])) for f in range(x.shape[1])]
        edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
        codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        z = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            tree, step = _grow(codes, edges, y - p, p * (1 - p), depth, least, rate)
            z = z + step
            self.trees.append(tree)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
