"""Hashed sparse logistic regression for the classifiers: features as index arrays, fitted on the driver on bounded samples."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class Rows:
    """Sparse binary rows: the indices of the features that each has, worked through in blocks of bounded size."""

    BLOCK = 1 << 20

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.n = width, len(rows)
        self.index = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])

    def blocks(self):
        for i in range(0, len(self.index), self.BLOCK):
            yield self.index[i : i + self.BLOCK], self.row[i : i + self.BLOCK]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for index, row in self.blocks():
            out += np.bincount(row, w[index], self.n)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for index, row in self.blocks():
            out += np.bincount(index, g[row], self.width)
        return out

    def taken(self, at: np.ndarray) -> Rows:
        """The rows with the ascending numbers at."""
        to = np.full(self.n, -1, np.int32)
        to[at] = np.arange(len(at), dtype=np.int32)
        out, held = Rows([], self.width), to[self.row] >= 0
        out.n, out.index, out.row = len(at), self.index[held], to[self.row[held]]
        return out

    def followed(self, more: Rows) -> Rows:
        """These rows, then more."""
        out = Rows([], self.width)
        out.n, out.index, out.row = self.n + more.n, np.concatenate([self.index, more.index]), np.concatenate([self.row, more.row + np.int32(self.n)])
        return out

    def narrowed(self, kept: np.ndarray) -> Rows:
        """The same rows with the kept features alone, renumbered."""
        to = np.full(self.width, -1, np.int32)
        to[kept] = np.arange(len(kept), dtype=np.int32)
        out = Rows([], len(kept))
        held = to[self.index] >= 0
        out.n, out.index, out.row = self.n, to[self.index[held]], self.row[held]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(dot, back, width: int, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps with a backtracked step length."""
    w, b, vw, vb, step, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0, 1.0
    total = max(weight.sum(), 1e-12)

    def loss(w, b, z):
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / total + penalty * (w @ w) / 2)

    for _ in range(steps):
        z = dot(vw) + vb
        g = weight * (sigmoid(z) - y) / total
        gw, gb, here = back(g) + penalty * vw, g.sum(), loss(vw, vb, z)
        while True:
            nw, nb = vw - step * gw, vb - step * gb
            if loss(nw, nb, dot(nw) + nb) <= here - step * (gw @ gw + gb * gb) / 2 + 1e-12 or step < 1e-9:
                break
            step /= 2
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t, step = nw, nb, nt, step * 1.3
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, balanced: bool = False, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that calibrate scores to probabilities, with smoothed targets and a prior of one row's weight.

    balanced: as if both classes were as frequent, so that scores which tell nothing get one half.
    """
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return (0.0, 0.0) if balanced else (1.0, 0.0)
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg)) if balanced else np.ones(len(y))
    mean, sd = score.mean(), score.std() or 1.0
    x = (score - mean) / sd
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * x * x).sum() + 1.0, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hessian, [(g * x).sum() + a, g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a / sd), float(b - a * mean / sd)


def fit_mix(a: np.ndarray, b: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float, float]:
    """Weights of two log-odds, none negative, and a shift, for the odds of both: 1, 1 and 0 if they are independent.

    Classes weigh alike; the pull towards 1, 1, 0 has one row's weight. One class: no change.
    """
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 1.0, 0.0
    x, start = np.stack([a, b, np.ones(len(y))], 1), np.array([1.0, 1.0, 0.0])
    weight, theta = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg)), start
    for _ in range(steps):
        p = sigmoid(x @ theta)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(3)
        theta = theta - np.linalg.solve(hessian, x.T @ (weight * (p - y)) + theta - start)
        theta[:2] = np.maximum(theta[:2], 0)
    return tuple(float(t) for t in theta)


def once(index: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The indices without repeats, in any order; scratch: as many int32 as there are features, with any values."""
    at = np.arange(len(index), dtype=np.int32)
    scratch[index] = at
    return index[scratch[index] == at]
