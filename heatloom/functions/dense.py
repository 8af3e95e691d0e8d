"""Small dense algebra on the driver or inside a task: factorisations, optimisers, simplex projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed value: added to sums before dividing by them, so that empty rows and columns stay finite.
TINY = 1e-9


def cholesky(a: np.ndarray) -> np.ndarray:
    """The lower factor of ``a``; a growing jitter is tried before an error is raised."""
    scale = max(float(np.mean(np.diag(a))), 1e-300)
    for jitter in (0.0, 1e-10, 1e-8, 1e-6):
        try:
            return np.linalg.cholesky(a + jitter * scale * np.eye(len(a)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("matrix is not positive definite")


def solve_chol(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(lower.T, np.linalg.solve(lower, b))


def top_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenpairs of a symmetric matrix, descending, the largest entry of each vector positive."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def squared_distances(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``x`` and ``u``, never below zero."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ u.T + (u * u).sum(1)[None, :], 0.0)


def project_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point of the probability simplex to each row of ``v``."""
    down = -np.sort(-v, axis=1)
    excess = (np.cumsum(down, axis=1) - 1) / np.arange(1, v.shape[1] + 1)
    last = (down > excess).sum(axis=1) - 1
    return np.maximum(v - excess[np.arange(len(v)), last][:, None], 0.0)


def local_weights(x: np.ndarray, anchors: np.ndarray, tol: float = 1e-5, steps: int = 100) -> np.ndarray:
    """Convex weights of each row's own anchors (rows, r, d) that rebuild it best.

    Accelerated projected gradient with backtracking for all rows at once; a row is frozen when its step falls
    below ``tol``. The curvature estimate stays with the row and doubles at most 60 times a step.
    """
    n, r, _ = anchors.shape
    z = previous = np.full((n, r), 1.0 / r)
    beta, before, now = np.ones(n), 0.0, 1.0
    live = np.arange(n)

    def residual(w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return x[at] - np.einsum("nr,nrd->nd", w, anchors[at])

    for _ in range(steps):
        momentum = (before - 1) / now
        v = z[live] + momentum * (z[live] - previous[live])
        gap = residual(v, live)
        grad, value = -np.einsum("nrd,nd->nr", anchors[live], gap), 0.5 * (gap * gap).sum(1)
        new, trying = np.empty_like(v), np.arange(len(live))
        for _ in range(60):
            b = beta[live[trying]]
            cand = project_simplex(v[trying] - grad[trying] / b[:, None])
            step = cand - v[trying]
            bound = value[trying] + (grad[trying] * step).sum(1) + 0.5 * b * (step * step).sum(1)
            rest = residual(cand, live[trying])
            new[trying] = cand
            fails = 0.5 * (rest * rest).sum(1) > bound + 1e-14
            if not fails.any():
                break
            trying = trying[fails]
            beta[live[trying]] *= 2
        moved = ((new - z[live]) ** 2).sum(1)
        previous = previous.copy()
        previous[live] = z[live]
        z = z.copy()
        z[live] = new
        live = live[moved >= tol]
        before, now = now, (1 + np.sqrt(1 + 4 * now * now)) / 2
        if not len(live):
            break
    return z


def minimize_log(f: Callable[[float], float], start: float, low: float, high: float = 1e8, rtol: float = 1e-4) -> tuple[float, float]:
    """A minimum of ``f`` over [low, high]: a coarse scan in the logarithm, then golden sections around its best point."""
    return minimize_log_many(lambda xs: [f(x) for x in xs], start, low, high, rtol, 0)


def minimize_log_many(f: Callable[[list[float]], list[float]], start: float, low: float, high: float = 1e8, rtol: float = 1e-4, ahead: int = 3) -> tuple[float, float]:
    """``minimize_log`` for an ``f`` of several values at once, where a call is dear: the scan is one call, and each call
    of the golden sections has all points that the next ``ahead`` steps can come to. The points taken are the same."""
    ratio = (np.sqrt(5) - 1) / 2
    known: dict[float, float] = {}

    def evaluate(points: list[float]) -> None:
        new = [g for g in dict.fromkeys(points) if g not in known]
        if new:
            known.update(zip(new, f([float(np.exp(g)) for g in new]), strict=True))

    def inner(a: float, b: float) -> tuple[float, float]:
        return b - ratio * (b - a), a + ratio * (b - a)

    def reachable(a: float, b: float, c: float, d: float, steps: int) -> list[float]:
        if steps < 0:
            return []
        return [c, d, *reachable(a, d, inner(a, d)[0], c, steps - 1), *reachable(c, b, d, inner(c, b)[1], steps - 1)]

    grid = np.unique(np.r_[np.log(start), np.linspace(np.log(low), np.log(high), 28)])
    evaluate(grid.tolist())
    values = [known[g] for g in grid.tolist()]
    if not np.isfinite(values).any():
        raise FloatingPointError("the objective is nowhere finite")
    best = int(np.nanargmin(np.where(np.isfinite(values), values, np.inf)))
    a, b = float(grid[max(best - 1, 0)]), float(grid[min(best + 1, len(grid) - 1)])
    c, d = inner(a, b)
    while True:
        if c not in known or d not in known:
            evaluate(reachable(a, b, c, d, ahead) if b - a > rtol else [c, d])
        if b - a <= rtol:
            break
        if known[c] <= known[d]:
            b, d = d, c
            c = inner(a, b)[0]
        else:
            a, c = c, d
            d = inner(a, b)[1]
    options = [(values[best], float(grid[best])), (known[c], c), (known[d], d)]
    value, at = min(options, key=lambda o: o[0] if np.isfinite(o[0]) else np.inf)
    return float(np.exp(at)), float(value)


def minimize_positive(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, steps: int = 300, rtol: float = 1e-7) -> tuple[np.ndarray, float]:
    """A local minimum over x >= low > 0 of ``f`` (value and gradient): limited-memory BFGS in log(x), steps cut at the bounds."""
    floor = np.log(low)
    u = np.maximum(np.log(start), floor)
    value, grad = f(np.exp(u))
    grad = grad * np.exp(u)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        free = ~((u <= floor + 1e-12) & (grad > 0))
        q = np.where(free, grad, 0.0)
        if np.abs(q).max(initial=0.0) < 1e-8:
            break
        alphas = []
        for s, y in reversed(memory):
            alphas.append((s @ q) / (s @ y))
            q = q - alphas[-1] * y
        if memory:
            q = q * (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1])
        for (s, y), alpha in zip(memory, reversed(alphas), strict=True):
            q = q + s * (alpha - (y @ q) / (s @ y))
        step = -np.where(free, q, 0.0)
        if step @ grad >= 0:
            step, memory = -np.where(free, grad, 0.0), []
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        size = 1.0
        while True:
            new = np.maximum(u + size * step, floor)
            new_value, new_grad = f(np.exp(new))
            if np.isfinite(new_value) and new_value <= value + 1e-4 * grad @ (new - u):
                break
            size /= 2
            if size < 1e-10:
                return np.exp(u), value
        new_grad = new_grad * np.exp(new)
        s, y = new - u, new_grad - grad
        if s @ y > 1e-12:
            memory = [*memory[-9:], (s, y)]
        done = abs(value - new_value) <= rtol * (1 + abs(value))
        u, value, grad = new, new_value, new_grad
        if done:
            break
    return np.exp(u), value
