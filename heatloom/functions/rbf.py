"""Regression by a subset of regressors: a squared-exponential kernel exp(-d2 / (2 t)) seen through anchors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from heatloom.functions.dense import cholesky, minimize_positive, solve_chol, squared_distances
from heatloom.functions.gp import NOISE_PRIOR, check_approach

T_LOW, NOISE_LOW, STEP = 1e-4, 1e-4, 1e-4


@dataclass(frozen=True)
class RbfFit:
    t: float
    noise: float | np.ndarray
    objective: float
    u: np.ndarray
    weights: np.ndarray  # a row's mean is kernel(row, u) @ weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return kernel(squared_distances(x, self.u), self.t) @ self.weights


def kernel(d2: np.ndarray, t: float) -> np.ndarray:
    return np.exp(-d2 / (2 * t))


def evidence(d2_xu: np.ndarray, d2_uu: np.ndarray, y: np.ndarray, t: float, z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log evidence (less a constant) under row noises ``z``, its gradient in them, and the anchors' weights."""
    q = y.shape[1]
    c, k = kernel(d2_xu, t), kernel(d2_uu, t)
    k = k + 1e-8 * np.eye(len(k))
    scaled = c / z[:, None]
    lower = cholesky(k + c.T @ scaled)
    weights = solve_chol(lower, scaled.T @ y)
    alpha = (y - c @ weights) / z[:, None]
    part = np.linalg.solve(lower, scaled.T)
    value = 0.5 * (y * alpha).sum() / q + np.log(np.diag(lower)).sum() - np.log(np.diag(cholesky(k))).sum() + 0.5 * np.log(z).sum()
    return float(value), 0.5 * (1 / z - (part**2).sum(0)) - 0.5 * (alpha**2).sum(1) / q, weights


def fit_rbf(x: np.ndarray, y: np.ndarray, u: np.ndarray, sigma: float = 1e-5, noise: str = "same", approach: str = "posterior") -> RbfFit:
    """The best t and noise (one, or one for each row), and what predicts from them."""
    if noise not in ("same", "different"):
        raise ValueError(f"noise must be same or different, not {noise!r}")
    posterior = check_approach(approach)
    y = y.reshape(len(x), -1)
    d2_xu, d2_uu, m = squared_distances(x, u), squared_distances(u, u), len(x)
    spread = (lambda p: np.full(m, p[1])) if noise == "same" else (lambda p: p[1:])

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = spread(p) + sigma
        try:
            value, by_row, _ = evidence(d2_xu, d2_uu, y, p[0], z)
            up, down = (evidence(d2_xu, d2_uu, y, p[0] * np.exp(s * STEP), z)[0] for s in (1, -1))
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(len(p))
        if posterior:
            a, b = NOISE_PRIOR
            value += ((a + 1) * np.log(z) + b / z).mean()
            by_row = by_row + ((a + 1) / z - b / z**2) / m
        by_noise = np.array([by_row.sum()]) if noise == "same" else by_row
        return value, np.r_[(up - down) / (2 * STEP) / p[0], by_noise]

    size = 1 if noise == "same" else m
    best, objective = minimize_positive(f, np.ones(1 + size), np.r_[T_LOW, np.full(size, NOISE_LOW)])
    weights = evidence(d2_xu, d2_uu, y, best[0], spread(best) + sigma)[2]
    return RbfFit(float(best[0]), float(best[1]) if noise == "same" else best[1:], -objective, u, weights)


@dataclass(frozen=True)
class RbfSums:
    """All that one noise needs of the rows at one t: C'C, C'Y, Y'Y and their number, for C = kernel(rows, anchors)."""

    gram: np.ndarray
    cross: np.ndarray
    square: float
    rows: float

    @staticmethod
    def flat(x: np.ndarray, y: np.ndarray, u: np.ndarray, t: float) -> np.ndarray:
        c = kernel(squared_distances(x, u), t)
        return np.r_[(c.T @ c).ravel(), (c.T @ y).ravel(), (y * y).sum(), len(x)]

    @classmethod
    def of(cls, flat: np.ndarray, s: int) -> RbfSums:
        return cls(flat[: s * s].reshape(s, s), flat[s * s : -2].reshape(s, -1), float(flat[-2]), float(flat[-1]))


def evidence_of_sums(sums: RbfSums, d2_uu: np.ndarray, t: float, z: float) -> tuple[float, float, np.ndarray]:
    """As ``evidence`` with one noise ``z`` for all rows: the value, its gradient in z, and the anchors' weights."""
    q, k = sums.cross.shape[1], kernel(d2_uu, t) + 1e-8 * np.eye(len(d2_uu))
    lower = cholesky(k + sums.gram / z)
    weights = solve_chol(lower, sums.cross / z)
    quadratic = (sums.square - (sums.cross * weights).sum()) / z
    value = 0.5 * quadratic / q + np.log(np.diag(lower)).sum() - np.log(np.diag(cholesky(k))).sum() + 0.5 * sums.rows * np.log(z)
    part = np.trace(np.linalg.solve(lower, np.linalg.solve(lower, sums.gram).T)) / z**2
    alpha = (sums.square - 2 * (sums.cross * weights).sum() + (weights * (sums.gram @ weights)).sum()) / z**2
    return float(value), float(0.5 * (sums.rows / z - part) - 0.5 * alpha / q), weights


def fit_rbf_by_sums(passed: Callable[[list[float]], list[RbfSums]], u: np.ndarray, sigma: float = 1e-5, approach: str = "posterior") -> RbfFit:
    """``fit_rbf`` with one noise where rows stay elsewhere: a call of ``passed`` sums over them for several t at once."""
    posterior, d2_uu = check_approach(approach), squared_distances(u, u)
    known: dict[float, RbfSums] = {}

    def at(times: list[float]) -> list[RbfSums]:
        new = [t for t in times if t not in known]
        if len(known) > 12:
            known.clear()
            new = times
        known.update(zip(new, passed(new) if new else [], strict=True))
        return [known[t] for t in times]

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        z, times = p[1] + sigma, [float(p[0] * np.exp(s * STEP)) for s in (0, 1, -1)]
        try:
            (value, by_noise, _), (up, _, _), (down, _, _) = (evidence_of_sums(s, d2_uu, t, z) for s, t in zip(at(times), times, strict=True))
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(2)
        if posterior:
            a, b = NOISE_PRIOR
            value, by_noise = value + (a + 1) * np.log(z) + b / z, by_noise + (a + 1) / z - b / z**2
        return value, np.array([(up - down) / (2 * STEP) / p[0], by_noise])

    best, objective = minimize_positive(f, np.ones(2), np.array([T_LOW, NOISE_LOW]))
    t, noise = float(best[0]), float(best[1])
    weights = evidence_of_sums(at([t])[0], d2_uu, t, noise + sigma)[2]
    return RbfFit(t, noise, -objective, u, weights)
