"""Small linear models, fitted on bounded samples of sparse rows."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray, int]  # places, values, class


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(score):
    return 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))


def ftrl(rows: list[Row], n_features: int, n_classes: int, *, epochs: int = 3,
         alpha: float = 1.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0,
         free_from: int | None = None, seed: int = 0) -> np.ndarray:
    """Multinomial weights, (n_features + 1) x n_classes; the last row is the constant.

    Follow the regularised leader: each coordinate has its own learning rate; the
    absolute penalty l1 keeps weights of uninformative features at exactly zero, l2
    keeps the others small. Features from `free_from` on, and the constant, have no l1 then.
    """
    end = n_features + 1 if free_from is None else free_from
    z = np.zeros((n_features + 1, n_classes))
    squares = np.zeros_like(z)

    def weights(z: np.ndarray, squares: np.ndarray, at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at < end, l1, 0.0)[:, None], 0)
        return -shrunk / ((beta + np.sqrt(squares)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, n_features), np.append(values, 1.0)
            w = weights(z[at], squares[at], at)
            error = softmax(values @ w)
            error[label] -= 1.0
            gradient = values[:, None] * error
            grown = squares[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(squares[at])) / alpha * w
            squares[at] = grown
    return weights(z, squares, np.arange(n_features + 1))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression without a constant, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = l2 * len(x) * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        margin = x @ w * (2 * y - 1)
        return np.logaddexp(0, -margin).sum() + w @ penalty @ w / 2

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, gradient)
        size = 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-9 * (1 + now):
            break
        w, now = w - size * step, then
    return w
