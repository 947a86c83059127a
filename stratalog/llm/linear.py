"""Logistic regression on sparse rows, for models fitted on bounded samples."""

from __future__ import annotations

import math

import numpy as np


class Rows:
    """Sparse rows: for each row its feature numbers and their values."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], features: int):
        self.size, self.features = len(rows), features
        self.columns = np.concatenate([np.empty(0, np.int64), *[c for c, _ in rows]]).astype(np.int64)
        self.values = np.concatenate([np.empty(0), *[v for _, v in rows]]).astype(np.float64)
        self.owner = np.repeat(np.arange(self.size), [len(c) for c, _ in rows])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * weights[self.columns], self.size)

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * per_row[self.owner], self.features)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(
    rows: Rows, target: np.ndarray, importance: np.ndarray, penalty: float, steps: int, start: np.ndarray | None = None
) -> np.ndarray:
    """Weights, the last one the intercept, that minimise the mean log loss plus an L2 penalty.

    ``target`` may be probabilities. Limited-memory BFGS with backtracking; no randomness.
    """
    total = max(float(importance.sum()), 1e-9)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.clip(rows.times(w[:-1]) + w[-1], -60, 60)
        value = float(importance @ (np.logaddexp(0, margin) - target * margin)) / total
        error = importance * (sigmoid(margin) - target) / total
        slope = np.append(rows.back(error) + penalty * w[:-1], error.sum())
        return value + 0.5 * penalty * float(w[:-1] @ w[:-1]), slope

    w = np.zeros(rows.features + 1) if start is None else start.copy()
    value, slope = loss(w)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction, stack = -slope, []
        for s, y, rho in reversed(history):
            a = rho * (s @ direction)
            stack.append(a)
            direction = direction - a * y
        if history:
            s, y, _ = history[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y, rho), a in zip(history, reversed(stack)):
            direction = direction + s * (a - rho * (y @ direction))
        downhill = float(slope @ direction)
        if downhill > -1e-12:
            break
        length = 1.0
        while length > 1e-6:
            new_value, new_slope = loss(w + length * direction)
            if new_value <= value + 1e-4 * length * downhill:
                break
            length /= 2
        else:
            break
        s, y = length * direction, new_slope - slope
        if s @ y > 1e-12:
            history = [*history[-9:], (s, y, 1.0 / float(s @ y))]
        w, value, slope = w + s, new_value, new_slope
    return w


def platt(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into calibrated log odds, with smoothed targets."""
    if not len(margin):
        return 1.0, 0.0
    ones = float((target > 0.5).sum())
    zeros = len(target) - ones
    smooth = np.where(target > 0.5, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(np.abs(margin).max()), 1e-9)
    rows = Rows([(np.zeros(1, int), np.array([m / scale])) for m in margin], 1)
    slope, intercept = fit_logistic(rows, smooth, np.ones(len(margin)), 1e-6, 50)
    return (float(slope) / scale, float(intercept)) if slope > 0 and math.isfinite(slope) else (1.0, 0.0)
