"""A small ridge logistic regression for bounded samples, by Newton steps."""
import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(x, y, weight=None, ridge=1.0, steps=40):
    """(coefficients, intercept) of labels 0/1 on the rows of `x`; the intercept is not penalised."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], float(ridge))
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]
