"""Linear models fitted in numpy on a bounded sample of sparse rows: hinge loss by dual coordinate descent."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


DOT_ROWS = 256


class Rows(NamedTuple):
    """Sparse rows: row i has ``values[ends[i]:ends[i + 1]]`` at ``indices[...]``, in 32 bits where they fit."""

    ends: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        parts = [slice(self.ends[i], self.ends[i + 1]) for i in rows]
        ends = np.concatenate([[0], np.cumsum([p.stop - p.start for p in parts])]).astype(np.int64)
        if not parts:
            return Rows(ends, self.indices[:0], self.values[:0])
        return Rows(ends, np.concatenate([self.indices[p] for p in parts]), np.concatenate([self.values[p] for p in parts]))

    def dot(self, weights: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Of all rows or of those numbered ``rows``; a few rows at a time, so that no copy of all values is made."""
        rows, out = np.arange(len(self)) if rows is None else rows, []
        for i in range(0, len(rows), DOT_ROWS):
            part = self.take(rows[i : i + DOT_ROWS])
            total = np.concatenate([[0.0], np.cumsum(part.values * weights[part.indices], dtype=np.float64)])
            out.append(total[part.ends[1:]] - total[part.ends[:-1]])
        return np.concatenate(out) if out else np.empty(0)

    def __len__(self) -> int:  # type: ignore[override]
        return len(self.ends) - 1


def rows_of(lists: list[np.ndarray], values: list[np.ndarray] | None = None) -> Rows:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    held = np.concatenate(values) if values else np.ones(len(flat), np.float32)
    return Rows(ends, flat.astype(np.int32, copy=False), held)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def margins(self, rows: Rows, at: np.ndarray | None = None) -> np.ndarray:
        return rows.dot(self.weights, at) + self.bias


def fit_hinge(
    rows: Rows,
    signs: np.ndarray,
    size: int,
    cost: np.ndarray | float = 1.0,
    epochs: int = 15,
    seed: int = 0,
    at: np.ndarray | None = None,
) -> Model:
    """Weights that minimise the regularised hinge loss, one dual variable at a time; the bias is one more feature.

    ``at``: the numbers of the rows to learn from, which ``signs`` and ``cost`` go with; they are not copied.
    """
    at = np.arange(len(rows)) if at is None else at
    n = len(at)
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    cost = np.broadcast_to(np.asarray(cost, np.float64), n)
    own = [slice(a, b) for a, b in zip(rows.ends[at].tolist(), rows.ends[at + 1].tolist(), strict=True)]
    squares = [float(np.sum(rows.values[x] ** 2, dtype=np.float64)) + 1.0 for x in own]
    order, rng = np.arange(n), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            where, x, y, old = rows.indices[own[i]], rows.values[own[i]], signs[i], alpha[i]
            slope = y * (weights[where] @ x + bias) - 1.0
            new = min(max(old - slope / squares[i], 0.0), cost[i])
            if new != old:
                step = (new - old) * y
                weights[where] += step * x  # the indices of a row are distinct
                bias += step
                alpha[i] = new
                most = max(most, abs(new - old))
        if most < 1e-3:
            break
    return Model(weights, bias)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Scale(NamedTuple):
    """Probability of the positive class from a margin."""

    slope: float
    shift: float

    def __call__(self, margin):
        return logistic(self.slope * margin + self.shift)


def fit_scale(margins: np.ndarray, positive: np.ndarray, rounds: int = 50) -> Scale:
    """Logistic fit of smoothed outcomes on margins, by damped Newton steps."""
    up, down = positive.sum(), len(positive) - positive.sum()
    aim = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(rounds):
        p = logistic(x @ w)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - aim))
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Scale(max(float(w[0]), 1e-3), float(w[1]))


def fit_scaled(
    rows: Rows, positive: np.ndarray, size: int, folds: int = 3, at: np.ndarray | None = None, **how
) -> tuple[Model, Scale]:
    """Model on all rows (or those numbered ``at``); its scale from margins of rows that a fold's model has not seen."""
    at = np.arange(len(rows)) if at is None else at
    signs, n = np.where(positive, 1.0, -1.0), len(at)
    fold, margins = np.arange(n) % folds, np.zeros(n)
    cost = np.broadcast_to(np.asarray(how.pop("cost", 1.0), np.float64), n)
    for k in range(folds):
        seen, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = fit_hinge(rows, signs[seen], size, cost=cost[seen], at=at[seen], **how)
        margins[rest] = part.margins(rows, at[rest])
    return fit_hinge(rows, signs, size, cost=cost, at=at, **how), fit_scale(margins, positive)
