"""Calibrators fitted on rows in memory, to hold the fits on sums against."""

import numpy as np


def temperature(p: np.ndarray, y: np.ndarray) -> float:
    """Temperature that minimises log loss, by golden-section search on its logarithm."""
    logs = np.log(np.clip(p, 1e-15, 1))

    def loss(x: float) -> float:
        z = logs / np.exp(x)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, ratio = -1.6, 1.6, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def tempered(p: np.ndarray, t: float) -> np.ndarray:
    q = np.clip(p, 1e-15, 1) ** (1 / t)
    return q / q.sum(axis=1, keepdims=True)


def dirichlet(p: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
    """Multinomial logistic map of log probabilities, shrunk toward the identity, by damped Newton steps."""
    x = np.hstack([np.log(np.clip(p, 1e-15, 1)), np.ones((len(p), 1))])
    k, d = p.shape[1], x.shape[1]
    start = np.hstack([np.eye(k), np.zeros((k, 1))])
    w, hit = start.copy(), np.eye(k)[y]

    def soft(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = x @ w.T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        q = soft(w, x)
        g = ((q - hit).T @ x + ridge * (w - start)).ravel()
        h = ridge * np.eye(k * d)
        for a in range(k):
            for b in range(k):
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] += (x * (q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x
        step = np.linalg.solve(h, g)
        w = w - (step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))).reshape(k, d)
        if np.abs(step).max() < 1e-8:
            break
    return lambda new: soft(w, np.hstack([np.log(np.clip(new, 1e-15, 1)), np.ones((len(new), 1))]))


def isotonic(p: np.ndarray, hit: np.ndarray):
    """Monotone step fit of a hit rate on a probability: neighbours that fall are pooled."""
    order = np.argsort(p, kind="mergesort")
    pools: list[list[float]] = []  # mean, weight, first p
    for x, v in zip(p[order], hit[order].astype(float), strict=True):
        pools.append([v, 1.0, x])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v1, w1, _ = pools.pop()
            v0, w0, x0 = pools[-1]
            pools[-1] = [(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, x0]
    edges, values = np.array([x for _, _, x in pools]), np.array([v for v, _, _ in pools])
    return lambda new: values[np.clip(np.searchsorted(edges, new, "right") - 1, 0, len(values) - 1)]


def platt(p: np.ndarray, hit: np.ndarray, rounds: int = 30):
    """Logistic recalibration of one class."""
    z = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    x, t = np.stack([np.ones(len(p)), z(p)], axis=1), np.array([0.0, 1.0])
    for _ in range(rounds):
        m = 1 / (1 + np.exp(-x @ t))
        step = np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (m - hit))
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    return lambda new: 1 / (1 + np.exp(-(t[0] + t[1] * z(new))))


def one_vs_rest(fit, p: np.ndarray, y: np.ndarray, floor: float = 1e-3):
    parts = [fit(p[:, k], y == k) for k in range(p.shape[1])]

    def apply(new: np.ndarray) -> np.ndarray:
        q = np.clip(np.stack([f(new[:, k]) for k, f in enumerate(parts)], axis=1), floor, None)
        return q / q.sum(axis=1, keepdims=True)

    return apply


CALIBRATORS = {
    "temperature": lambda p, y: (lambda t: lambda new: tempered(new, t))(temperature(p, y)),
    "dirichlet": dirichlet,
    "ovr_isotonic": lambda p, y: one_vs_rest(isotonic, p, y),
    "ovr_platt": lambda p, y: one_vs_rest(platt, p, y),
}
