"""Gradient-boosted trees with calibrated probabilities, in NumPy.

Small enough to be fitted on a bounded sample on the driver and shipped to the
workers; prediction is vectorised over whole Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _alike(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct row of small numbers the first position, and for each row
    which of them it is."""
    code, size = np.zeros(len(columns[0]), dtype=np.int64), 1
    for v in columns:
        n = int(v.max(initial=0)) + 1
        if size * n >= 2**62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code, size = code * n + v, size * n
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return first, which


@dataclass
class Boosted:
    """Binary classifier. NaN is a value of its own (it goes left)."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    penalty: float = 1.0
    least: int = 5
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, dtype=np.int16)
        for j, e in enumerate(self.edges):
            v = x[:, j]
            out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="right") + 1)
        return out

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int16), np.zeros(size)
        rows = {0: np.arange(len(g))}
        width, columns = self.bins + 2, np.ascontiguousarray(b.T, dtype=np.intp)
        for node in range(size):
            at = rows.pop(node, None)
            if at is None:
                continue
            ga, ha, na = g[at], h[at], n[at]
            gs, hs, ns = ga.sum(), ha.sum(), na.sum()
            value[node] = -gs / (hs + self.penalty)
            if node >= 2**self.depth - 1 or ns < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                k = columns[j][at]
                cg = np.cumsum(np.bincount(k, ga, width))[:-1]
                ch = np.cumsum(np.bincount(k, ha, width))[:-1]
                cn = np.cumsum(np.bincount(k, na, width))[:-1]
                gain = cg**2 / (ch + self.penalty) + (gs - cg) ** 2 / (hs - ch + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(cn < self.least) | (ns - cn < self.least)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, i)
            if best[1] < 0:
                continue
            feature[node], cut[node] = best[1], best[2]
            left = b[at, best[1]] <= best[2]
            rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 7, groups: np.ndarray | None = None) -> Boosted:
        """Fits on four fifths of the rows and calibrates on the others (Platt).
        Rows of one group (by default each row its own) stay together."""
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
        self.edges = []
        for j in range(x.shape[1]):
            v = x[:, j][~np.isnan(x[:, j])]
            distinct = np.unique(v)
            middle = (distinct[1:] + distinct[:-1]) / 2
            self.edges.append(middle if len(middle) <= self.bins else np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1])))
        b = self._binned(x)
        _, group = np.unique(np.arange(len(y)) if groups is None else groups, return_inverse=True)
        parts = int(group.max()) + 1 if len(group) else 0
        held = np.zeros(parts, dtype=bool)
        held[np.random.default_rng(seed).permutation(parts)[: parts // 5]] = parts >= 50
        held = held[group]
        # rows alike in all that counts are one, with their number and the sum of their weights
        first, which = _alike([*b.T, np.unique(y, return_inverse=True)[1], held])
        n, w = np.bincount(which, minlength=len(first)).astype(float), np.bincount(which, w, len(first))
        b, y, held = b[first], y[first], held[first]
        fit = ~held
        rate = np.clip(np.average(y[fit], weights=w[fit]) if fit.any() else 0.5, 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds if 0 < y[fit].sum() < fit.sum() else 0):
            p = _sigmoid(z[fit])
            tree = self._grow(b[fit], (p - y[fit]) * w[fit], p * (1 - p) * w[fit], n[fit])
            tree = (tree[0], tree[1], tree[2] * self.rate)
            self.trees.append(tree)
            z += self._leaf(tree, b)
        if held.any():
            self._calibrate(z[held], y[held], w[held])
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        # the targets are drawn in a little, as Platt proposes
        up, down = (y * w).sum(), ((1 - y) * w).sum()
        t = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
        def loss(a: float, c: float) -> float:
            v = a * z + c
            return float((w * (np.logaddexp(0, v) - t * v)).sum() + 0.5 * (a - 1) ** 2)

        a, c = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(a * z + c)
            d, s = w * (p - t), w * p * (1 - p) + 1e-9
            grad = np.array([(d * z).sum() + (a - 1), d.sum()])
            hess = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            step, now = np.linalg.solve(hess, grad), loss(a, c)
            # where the classes are apart a full step may lead far astray
            while np.abs(step).max() >= 1e-8 and loss(a - step[0], c - step[1]) > now:
                step = step / 2
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-8:
                break
        if np.isfinite([a, c]).all() and a > 0:
            self.slope, self.shift = float(a), float(c)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        x = np.asarray(x, dtype=float)
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._leaf(tree, b)
        return _sigmoid(self.slope * z + self.shift)
