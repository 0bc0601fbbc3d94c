"""Rigid registration of 2-D point clouds, as NumPy kernels.

A cloud is an n x 2 matrix; its localisation uncertainties are a vector of n.
"""

from __future__ import annotations

import numpy as np


def rigid(points: np.ndarray, tx: float, ty: float, theta: float) -> np.ndarray:
    """Rotate by theta, then translate."""
    c, s = np.cos(theta), np.sin(theta)
    return points @ np.array([[c, s], [-s, c]]) + np.array([tx, ty])


#: Distances that one step holds at a time.
CHUNK = 1 << 21


def _rows(a: np.ndarray, b: np.ndarray):
    """Slices of a whose distances to b are one step."""
    step = max(1, CHUNK // max(len(b), 1))
    return (slice(k, k + step) for k in range(0, len(a), step))


def gauss_transform(a: np.ndarray, b: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Mean of exp(-d^2 / scale^2) over all pairs of points, and its gradient by each point of a."""
    total, g, n = 0.0, np.zeros_like(a, float), len(a) * len(b)
    for s in _rows(a, b):
        d = a[s, None, :] - b[None, :, :]
        e = np.exp(-(d * d).sum(2) / scale**2)
        total += e.sum()
        g[s] = (e[:, :, None] * d).sum(1)
    return float(total / n), -2 * g / (scale**2 * n)


def cost_and_gradient(model: np.ndarray, scene: np.ndarray, p: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Cost of the moved model against the scene, and its gradient by (tx, ty, theta)."""
    cost, g = gauss_transform(rigid(model, *p), scene, scale)
    m = g.T @ model
    c, s = np.cos(p[2]), np.sin(p[2])
    return cost, np.array([g[:, 0].sum(), g[:, 1].sum(), -m[0, 0] * s - m[0, 1] * c + m[1, 0] * c - m[1, 1] * s])


def exp_dist(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> float:
    """Sum of exp(-d^2 / (sigma_i + sigma_j)) over all pairs of points."""
    total = 0.0
    for s in _rows(a, b):
        d = a[s, None, :] - b[None, :, :]
        total += np.exp(-(d * d).sum(2) / (sa[s, None] + sb[None, :])).sum()
    return float(total)


def bfgs(f, start: np.ndarray, tolerance: float = 1e-15, iterations: int = 500) -> np.ndarray:
    """Minimise f (value, gradient) with a backtracking line search."""
    x = np.asarray(start, float)
    value, g = f(x)
    h = np.eye(len(x))
    for _ in range(iterations):
        if not np.isfinite(value) or np.abs(g).max() <= tolerance:
            break
        step = -h @ g
        if g @ step >= 0:
            h, step = np.eye(len(x)), -g
        t, slope = 1.0, g @ step
        while t > 1e-12:
            new = x + t * step
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, new_g - g
        if abs(value - new_value) <= tolerance * max(abs(value), 1e-300):
            x = new
            break
        x, value, g = new, new_value, new_g
        sy = s @ y
        if sy > 1e-18:
            r = np.eye(len(x)) - np.outer(s, y) / sy
            h = r @ h @ r.T + np.outer(s, s) / sy
    return x


ROTATIONS = np.arange(-4, 4) * np.pi / 4


def register(model: np.ndarray, scene: np.ndarray, sm: np.ndarray, ss: np.ndarray, scale: float = 1.0, tolerance: float = 1e-15, iterations: int = 500, guesses=ROTATIONS) -> tuple[float, float, float, float]:
    """(score, tx, ty, rotation) of the best of the fits from all guesses, by exp_dist."""

    def negative(p: np.ndarray) -> tuple[float, np.ndarray]:
        if not np.isfinite(p).all():
            return float("nan"), np.full(3, np.nan)
        c, g = cost_and_gradient(model, scene, p, scale)
        return -c, -g

    best = (-np.inf, 0.0, 0.0, 0.0)
    for theta in guesses:
        p = bfgs(negative, np.array([0.0, 0.0, theta]), tolerance, iterations)
        score = exp_dist(rigid(model, *p), scene, sm, ss)
        if score > best[0]:
            best = (score, float(p[0]), float(p[1]), float(p[2]))
    return best


def density_weights(points: np.ndarray, factor: float, bins: int = 100) -> np.ndarray:
    """Weight of each point: its bin's count after two 1-D Gaussian blurs of radius round(3.5 factor)."""
    low, high = points.min(0), points.max(0)
    span = np.where(high > low, high - low, 1)
    at = np.minimum(((points - low) / span * bins).astype(int), bins - 1)
    grid = np.zeros((bins, bins))
    np.add.at(grid, (at[:, 0], at[:, 1]), 1)
    r = max(1, round(3.5 * factor))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / factor) ** 2)
    for axis in (0, 1):
        grid = np.apply_along_axis(lambda v: np.convolve(v, kernel)[r : r + bins], axis, grid)
    return grid[at[:, 0], at[:, 1]]


def resample(points: np.ndarray, factor: float, keep: int, seed: int = 0, bins: int = 100) -> np.ndarray:
    """Numbers of at most `keep` points of the largest weight times a uniform number."""
    w = density_weights(points, factor, bins) * np.random.default_rng(seed).random(len(points))
    return np.sort(np.argsort(-w, kind="stable")[:keep])
