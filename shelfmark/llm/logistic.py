"""Ridge logistic regression on a small matrix of features, as the classifiers' last step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    intercept: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x, float) - self.mean) / self.scale @ self.theta + self.intercept


def fit(
    x: np.ndarray, y: np.ndarray, prior: float, ridge: float | np.ndarray = 1.0, rounds: int = 25, toward: np.ndarray | None = None
) -> Logistic:
    """``prior``: the share of ones among all labelled rows, of which x and y may be an uneven sample.  ``ridge`` (one number or one for each
    feature) pulls the weights to ``toward`` (of the features as given), or to 0."""
    n, k = x.shape
    if not n or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Logistic(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(p / (1 - p))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    theta, penalty = np.zeros(k + 1), np.diag([*np.broadcast_to(ridge, k), 1e-6])
    goal = np.zeros(k + 1) if toward is None else np.append(toward * scale, 0.0)
    for _ in range(rounds):
        p = sigmoid(z @ theta)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ (theta - goal))
        theta += step
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0.0
    return Logistic(mean, scale, theta[:k], float(theta[k] + shift))
