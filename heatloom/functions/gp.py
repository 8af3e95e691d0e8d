"""Gaussian-process algebra in the span of K eigenvectors; no matrix here is larger than rows by K.

The covariance of training rows is V L V' + ridge, where L = exp(-t (1 - values)).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from heatloom.functions import polyagamma
from heatloom.functions.dense import TINY, cholesky, minimize_log, minimize_positive, solve_chol

#: Fixed values. Priors: t enters as power * log t + (t / scale) ** -shape, a noise as inverse gamma.
REGRESSION_T, LOGIT_T, NOISE_PRIOR = (1.0, 10.0, 2.0), (1e-2, 10.0, 2.0), (0.1, 1e-3)
T_LOW, NOISE_LOW = 1e-3, 1e-4
#: What a row moves by at most, in the mean, where a Newton step that no longer halves is rounding.
ROUNDING = 1e-6


def heat(values: np.ndarray, t: float) -> np.ndarray:
    return np.exp(-t * (1 - values))


def t_prior(t: float, prior: tuple[float, float, float]) -> tuple[float, float]:
    power, shape, scale = prior
    with np.errstate(over="ignore"):
        return power * np.log(t + TINY) + (t / scale) ** -shape, power / (t + TINY) - shape / scale * (t / scale) ** (-shape - 1)


def settled(moved: float, before: float, rows: int, tol: float) -> bool:
    """Whether a Newton search is done, from what its last two steps moved all rows by, in sum.

    Rounding of many rows adds up to more than any fixed ``tol``; a search that has come to it no longer shrinks its steps.
    """
    return moved < tol or (moved < ROUNDING * rows and moved > 0.5 * before)


def check_approach(approach: str) -> bool:
    if approach not in ("posterior", "marginal"):
        raise ValueError(f"approach must be posterior or marginal, not {approach!r}")
    return approach == "posterior"


@dataclass(frozen=True)
class Moments:
    """What regression needs of the training rows: V'V, V'Y, Y'Y summed over outputs, and the number of rows."""

    gram: np.ndarray
    cross: np.ndarray
    square: float
    rows: int

    @classmethod
    def of(cls, v: np.ndarray, y: np.ndarray) -> Moments:
        y = y.reshape(len(v), -1)
        return cls(v.T @ v, v.T @ y, float((y * y).sum()), len(v))


@dataclass(frozen=True)
class RegressionFit:
    t: float
    noise: float | np.ndarray
    objective: float
    mean: np.ndarray  # a row's mean is v @ mean
    spread: np.ndarray  # its variance v @ spread @ v + floor
    floor: float


def regression_nmll(moments: Moments, values: np.ndarray, t: float, noise: float, sigma: float) -> tuple[float, np.ndarray]:
    """Negative log evidence (less a constant) with one noise, and its gradient in (t, noise)."""
    m, k, q = moments.rows, len(values), moments.cross.shape[1]
    v, lam = noise + sigma, heat(values, t)
    half = np.sqrt(lam)
    inner = half[:, None] * moments.gram * half
    lower = cholesky(inner + v * np.eye(k))
    b = half[:, None] * moments.cross
    qb = solve_chol(lower, b)
    value = 0.5 * (moments.square - (b * qb).sum()) / v / q + np.log(np.diag(lower)).sum() + 0.5 * (m - k) * np.log(v)
    inverse = solve_chol(lower, np.eye(k))
    c_alpha = (moments.cross - moments.gram @ (half[:, None] * qb)) / v  # V'C^-1 Y
    g_c = (moments.gram - moments.gram @ (half[:, None] * inverse * half) @ moments.gram) / v  # V'C^-1 V
    d_lam = -(1 - values) * lam
    d_t = 0.5 * (d_lam * np.diag(g_c)).sum() - 0.5 * (d_lam[:, None] * c_alpha**2).sum() / q
    alpha2 = (moments.square - 2 * (b * qb).sum() + (qb * (inner @ qb)).sum()) / v**2
    trace = (m - k) / v + np.trace(inverse)
    return float(value), np.array([d_t, 0.5 * trace - 0.5 * alpha2 / q])


def fit_regression(moments: Moments, values: np.ndarray, sigma: float = 1e-5, approach: str = "posterior") -> RegressionFit:
    """The best (t, noise) and what predicts from it."""
    posterior = check_approach(approach)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        try:
            value, grad = regression_nmll(moments, values, x[0], x[1], sigma)
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(2)
        if posterior:
            p, dp = t_prior(x[0], REGRESSION_T)
            a, b = NOISE_PRIOR
            v = x[1] + sigma
            value, grad = value + p + (a + 1) * np.log(v) + b / v, grad + np.array([dp, (a + 1) / v - b / v**2])
        return value, grad

    starts = [np.array([10.0, 1.0]), np.array([300.0, 1.0])]
    best, objective = min((minimize_positive(f, x, np.array([T_LOW, NOISE_LOW])) for x in starts), key=lambda r: r[1])
    return replace(regression_posterior(moments, values, float(best[0]), float(best[1]), sigma), objective=-objective)


def regression_posterior(moments: Moments, values: np.ndarray, t: float, noise: float, sigma: float) -> RegressionFit:
    """What predicts under a given (t, noise)."""
    lam, v = heat(values, t), noise + sigma
    half = np.sqrt(lam)
    lower = cholesky(half[:, None] * moments.gram * half + v * np.eye(len(values)))
    c_alpha = (moments.cross - moments.gram @ (half[:, None] * solve_chol(lower, half[:, None] * moments.cross))) / v
    spread = half[:, None] * solve_chol(lower, np.eye(len(values))) * half * v  # L - L V'C^-1 V L
    return RegressionFit(t, noise, float("nan"), lam[:, None] * c_alpha, spread, v)


def pointwise_nmll(v: np.ndarray, y: np.ndarray, values: np.ndarray, t: float, noise: np.ndarray, sigma: float) -> tuple[float, np.ndarray]:
    """Negative log evidence with a noise for each row, and its gradient in (t, noises)."""
    q, z, lam = y.shape[1], noise + sigma, heat(values, t)
    half = np.sqrt(lam)
    w = v * half
    lower = cholesky(np.eye(len(values)) + w.T @ (w / z[:, None]))
    alpha = (y - w @ solve_chol(lower, w.T @ (y / z[:, None]))) / z[:, None]
    value = 0.5 * (y * alpha).sum() / q + np.log(np.diag(lower)).sum() + 0.5 * np.log(z).sum()
    part = np.linalg.solve(lower, (w / z[:, None]).T)
    diagonal = 1 / z - (part**2).sum(0)
    va = v.T @ alpha
    vcv = v.T @ (v / z[:, None]) - (part @ v).T @ (part @ v)
    d_lam = -(1 - values) * lam
    d_t = 0.5 * (d_lam * np.diag(vcv)).sum() - 0.5 * (d_lam[:, None] * va**2).sum() / q
    return float(value), np.r_[d_t, 0.5 * diagonal - 0.5 * (alpha**2).sum(1) / q]


def fit_regression_pointwise(v: np.ndarray, y: np.ndarray, values: np.ndarray, sigma: float = 1e-5, approach: str = "posterior") -> RegressionFit:
    """As ``fit_regression`` with a noise for each training row; the variance of a new row takes their mean."""
    posterior = check_approach(approach)
    y = y.reshape(len(v), -1)
    m = len(v)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        try:
            value, grad = pointwise_nmll(v, y, values, x[0], x[1:], sigma)
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(m + 1)
        if posterior:
            p, dp = t_prior(x[0], REGRESSION_T)
            a, b = NOISE_PRIOR
            z = x[1:] + sigma
            value, grad = value + p + ((a + 1) * np.log(z) + b / z).mean(), grad + np.r_[dp, ((a + 1) / z - b / z**2) / m]
        return value, grad

    best, objective = minimize_positive(f, np.r_[10.0, np.ones(m)], np.r_[T_LOW, np.full(m, NOISE_LOW)])
    t, noise = float(best[0]), best[1:]
    lam, z = heat(values, t), noise + sigma
    half = np.sqrt(lam)
    w = v * half
    lower = cholesky(np.eye(len(values)) + w.T @ (w / z[:, None]))
    alpha = (y - w @ solve_chol(lower, w.T @ (y / z[:, None]))) / z[:, None]
    spread = half[:, None] * solve_chol(lower, np.eye(len(values))) * half
    return RegressionFit(t, noise, -objective, lam[:, None] * (v.T @ alpha), spread, float(noise.mean()) + sigma)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * f))


def log_sigmoid(f: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, -f)


#: Newton steps of a search from a like prior's mode before it begins again from zero.
WARM_STEPS = 12
#: Rows whose products are made at once, so that they stay in the cache.
ROWS = 4096


@dataclass(frozen=True)
class LaplaceMode:
    evidence: float
    f: np.ndarray
    gradient: np.ndarray  # Y - N pi at the mode
    weight: np.ndarray  # N pi (1 - pi)


def laplace_mode(v: np.ndarray, lam: np.ndarray, ridge: float, y: np.ndarray, trials: np.ndarray, tol: float = 1e-5, steps: int = 100, start: np.ndarray | None = None) -> LaplaceMode:
    """Newton's search for the mode of the latent values under V L V' + ridge, and the Laplace evidence.

    The mode is one, so that a search from ``start``, the mode of a like prior, comes to the same in fewer steps; where it doesn't settle
    in ``WARM_STEPS``, it begins again from zero.
    """
    half, k, n = np.sqrt(lam), len(lam), len(y)
    f = np.zeros(n) if start is None else start.copy()
    a, b, diagonal, share = np.empty((4, n))
    blocks = [slice(at, at + ROWS) for at in range(0, n, ROWS)]
    moved, done = np.inf, False
    for _ in range(steps if start is None else WARM_STEPS):
        second, target, scaled = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        for at in blocks:
            pi = sigmoid(f[at])
            weight = trials[at] * pi * (1 - pi)
            b[at] = weight * f[at] + y[at] - trials[at] * pi
            diagonal[at] = 1 + ridge * weight
            share[at] = weight / diagonal[at]
            shared = v[at] * share[at, None]
            second += shared.T @ v[at]
            target += b[at] @ v[at]
            scaled += b[at] @ shared
        second, target, scaled = half[:, None] * second * half, half * target, half * scaled
        lower = cholesky(np.eye(k) + second)
        u = target - solve_chol(lower, second @ target + ridge * scaled)
        sent = half[:, None] * np.stack([u, target - ridge * scaled - second @ u], 1)
        before, moved = moved, 0.0
        for at in blocks:
            own = v[at] @ sent
            a[at] = b[at] / diagonal[at] - share[at] * own[:, 0]
            new = own[:, 1] + ridge * a[at]
            moved += float(np.abs(new - f[at]).sum())
            f[at] = new
        if done := settled(moved, before, n, tol):
            break
    if start is not None and not done:
        return laplace_mode(v, lam, ridge, y, trials, tol, steps)
    evidence = -0.5 * a @ f + (y * log_sigmoid(f) + (trials - y) * log_sigmoid(-f)).sum() - 0.5 * np.log(diagonal).sum() - np.log(np.diag(lower)).sum()
    pi = sigmoid(f)
    return LaplaceMode(float(evidence), f, y - trials * pi, trials * pi * (1 - pi))


def factor(c: np.ndarray) -> np.ndarray:
    """V with V V' = ``c``, for covariances that are given whole."""
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = values > 0
    return vectors[:, keep] * np.sqrt(values[keep])


def marginal_log_likelihood_logit(c: np.ndarray, y: np.ndarray, trials: np.ndarray | None = None, tol: float = 1e-5, steps: int = 100) -> float:
    """Laplace log evidence of binomial labels under the covariance ``c``."""
    v = factor(c)
    return laplace_mode(v, np.ones(v.shape[1]), 0.0, y, np.ones(len(y)) if trials is None else trials, tol, steps).evidence


def posterior_classification(c11: np.ndarray, c21: np.ndarray, c22: np.ndarray, y: np.ndarray, trials: np.ndarray | None = None, tol: float = 1e-5, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Laplace mean and variance of the latent values of new rows; ``c22`` is their prior variance."""
    v = factor(c11)
    mode = laplace_mode(v, np.ones(v.shape[1]), 0.0, y, np.ones(len(y)) if trials is None else trials, tol, steps)
    root = np.sqrt(mode.weight)
    lower = cholesky(np.eye(len(y)) + root[:, None] * c11 * root)
    part = np.linalg.solve(lower, (c21 * root).T)
    return c21 @ mode.gradient, np.asarray(c22) - (part**2).sum(0)


def predict_regression(c: np.ndarray, y: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Posterior mean of new rows, cross @ c^-1 y."""
    return cross @ solve_chol(cholesky(c), y)


@dataclass(frozen=True)
class LogitFit:
    t: float
    objective: float
    mean: np.ndarray  # latent mean of a row: v @ mean
    spread: np.ndarray  # and its variance: v @ spread @ v + sigma
    label: np.ndarray  # latent value that labels follow: v @ label (and the row's own part)
    own: np.ndarray  # what ridge on the diagonal adds for training rows


def fit_logit(v: np.ndarray, values: np.ndarray, y: np.ndarray, trials: np.ndarray, sigma: float = 1e-3, approach: str = "posterior", sweeps: int = 100, seed: int = 0, ridge_in_posterior: bool = True, ridge_in_labels: bool = True, average: bool = False, best: tuple[float, float] | None = None) -> LogitFit:
    """The best t by the Laplace evidence, the Laplace posterior there, and Polya-Gamma weights for labels.

    Labels follow the last of ``sweeps`` Gibbs draws, or the mean of the later half of them with ``average``; ``best`` is what
    ``best_time`` gave, if it is known.
    """
    t, objective = best or best_time(v, values, y, trials, sigma, approach)
    lam = heat(values, t)
    mode = laplace_mode(v, lam, sigma if ridge_in_posterior else 0.0, y, trials)
    diagonal = 1 + (sigma if ridge_in_posterior else 0.0) * mode.weight
    p = v.T @ (v * (mode.weight / diagonal)[:, None])
    half = np.sqrt(lam)
    lower = cholesky(np.eye(len(lam)) + half[:, None] * p * half)
    spread = half[:, None] * solve_chol(lower, np.eye(len(lam))) * half
    omega = gibbs(v, lam, sigma, y, trials, sweeps, seed, average)
    weight = pg_weights(v, lam, sigma, y, trials, omega)
    return LogitFit(t, objective, lam * (v.T @ mode.gradient), spread, lam * (v.T @ weight), sigma * weight if ridge_in_labels else np.zeros(len(y)))


def best_time(v: np.ndarray, values: np.ndarray, y: np.ndarray, trials: np.ndarray, sigma: float, approach: str) -> tuple[float, float]:
    """The diffusion time of the largest log evidence (or posterior), and that value."""
    posterior = check_approach(approach)
    last: list[np.ndarray | None] = [None]  # the mode of the time before

    def f(t: float) -> float:
        try:
            mode = laplace_mode(v, heat(values, t), sigma, y, trials, start=last[0])
        except np.linalg.LinAlgError:
            return np.inf
        last[0] = mode.f if np.isfinite(mode.f).all() else None
        return -mode.evidence + (t_prior(t, LOGIT_T)[0] if posterior else 0.0)

    t, objective = minimize_log(f, 10.0, T_LOW)
    return t, -objective


def gibbs(v: np.ndarray, lam: np.ndarray, sigma: float, y: np.ndarray, trials: np.ndarray, sweeps: int, seed: int, average: bool = False) -> np.ndarray:
    """Polya-Gamma variables after ``sweeps`` rounds of drawing latent values and variables in turn."""
    rng = np.random.default_rng(seed)
    basis = v * np.sqrt(lam)
    omega, total = np.ones(len(y)), np.zeros(len(y))
    kappa = y - trials / 2
    for i in range(sweeps):
        # conditional draw: a prior draw, corrected by what it misses of noisy observations kappa / omega
        prior = basis @ rng.standard_normal(len(lam)) + np.sqrt(sigma) * rng.standard_normal(len(y))
        miss = kappa / omega - prior - rng.standard_normal(len(y)) / np.sqrt(omega)
        weight = ridge_solve(basis, sigma + 1 / omega, miss)
        f = prior + basis @ (basis.T @ weight) + sigma * weight
        omega = np.maximum(polyagamma.draw(np.maximum(trials, 1), f, rng), 1e-12)
        if i >= sweeps // 2:
            total += omega
    return total / (sweeps - sweeps // 2) if average else omega


def ridge_solve(basis: np.ndarray, diagonal: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(basis basis' + diag(diagonal))^-1 b."""
    scaled = basis / diagonal[:, None]
    lower = cholesky(np.eye(basis.shape[1]) + basis.T @ scaled)
    return b / diagonal - scaled @ solve_chol(lower, scaled.T @ b)


def pg_weights(v: np.ndarray, lam: np.ndarray, sigma: float, y: np.ndarray, trials: np.ndarray, omega: np.ndarray) -> np.ndarray:
    return ridge_solve(v * np.sqrt(lam), sigma + 1 / omega, (y - trials / 2) / omega)


def predict_pg_binary(c: np.ndarray, y: np.ndarray, cross: np.ndarray, sweeps: int = 100, output_pi: bool = False, trials: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Labels (or probabilities) of new rows by Polya-Gamma Gibbs sampling under the covariance ``c``."""
    trials = np.ones(len(y)) if trials is None else trials
    v = factor(c)
    omega = gibbs(v, np.ones(v.shape[1]), 0.0, y, trials, sweeps, seed)
    pi = sigmoid(cross @ pg_weights(v, np.ones(v.shape[1]), 0.0, y, trials, omega))
    return pi if output_pi else (pi > 0.5).astype(float)
