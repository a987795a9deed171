"""Sparse multinomial logistic regression: follow the regularised leader, elastic net, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


@dataclass
class Ftrl:
    """FTRL-proximal state; weights follow from it, and l1 keeps most of them at zero."""

    size: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z = np.zeros((self.size, self.classes))
        self.n = np.zeros((self.size, self.classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, row: Row, label: int, weight: float = 1.0) -> None:
        at, x = row
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = weight * x[:, None] * p
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[Row], labels: np.ndarray, size: int, classes: int, epochs: int = 2, seed: int = 7, weights: np.ndarray | None = None, **params: float) -> np.ndarray:
    """Weights (size, classes), one pass over the shuffled rows for each epoch."""
    model, order = Ftrl(size, classes, **params), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(rows[i], int(labels[i]), 1.0 if weights is None else float(weights[i]))
    return model.weights()


def scores(rows: list[Row], weights: np.ndarray) -> np.ndarray:
    return np.array([x @ weights[at] for at, x in rows]).reshape(len(rows), weights.shape[1])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def logistic(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients of a small dense logistic regression, the intercept last; Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
