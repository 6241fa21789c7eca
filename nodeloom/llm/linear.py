"""Linear classifiers on the driver, over a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, truth: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient; ``x`` rows x features in single precision, truth in -1/+1."""
    weight = weight / weight.sum()
    size = float(sum((w * np.square(part).sum(axis=1)).sum() for part, w in zip(np.array_split(x, 16), np.array_split(weight, 16), strict=True))) or 1.0
    root = 1 / np.sqrt(size)
    w, v, b, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for k in range(rounds):
        z = (x @ v.astype(np.float32)) * root + vb
        s = -truth * weight / (1 + np.exp(np.clip(truth * z, -30, 30)))
        grad = (s.astype(np.float32) @ x) * root + penalty * v
        nw, nb = v - 2.0 * grad, vb - 2.0 * float(s.sum())
        m = k / (k + 3)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w * root, b


def calibrate(z: np.ndarray, truth: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that turn margins into log odds (Platt's scaling): a penalised fit keeps margins too small, and
    with unequal classes the point of equal odds off. Targets are smoothed by the number of rows; Newton's method."""
    weight, up = weight / weight.sum(), truth > 0
    target = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    x = np.stack([z.astype(np.float64), np.ones(len(z))])
    loss = lambda v: float(weight @ (np.logaddexp(0, v @ x) - target * (v @ x)))
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        grad = x @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-12 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0)


def dense_svm(x: np.ndarray, truth: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge support vector machine by accelerated gradient, classes weighed alike."""
    up = truth > 0
    weight = np.where(up, 0.5 / max(1, up.sum()), 0.5 / max(1, (~up).sum())).astype(np.float32)
    size = float((weight * np.square(x).sum(axis=1)).sum()) or 1.0
    w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    root = np.float32(1 / np.sqrt(size))
    for k in range(rounds):
        z = (x @ v) * root + vb
        s = -2 * truth * weight * np.maximum(0, 1 - truth * z)
        grad = (x.T @ s.astype(np.float32)) * root + penalty * v
        nw, nb = v - 0.25 * grad, vb - 0.25 * float(s.sum())
        m = k / (k + 3)
        v, vb = (nw + m * (nw - w)).astype(np.float32), nb + m * (nb - b)
        w, b = nw.astype(np.float32), nb
    return w * root, b
