"""Draws from Polya-Gamma distributions by rejection from a two-piece envelope."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np

#: Where the envelope's inverse-Gaussian piece ends and its exponential piece begins.
CUT = 0.64


class Source(Protocol):
    """Random numbers for some places of an array, each place at most once a call."""

    def uniform(self, at: np.ndarray) -> np.ndarray: ...

    def exponential(self, at: np.ndarray) -> np.ndarray: ...

    def wald(self, at: np.ndarray, mean: np.ndarray) -> np.ndarray: ...


class Sequence:
    """Numbers in the order in which they are asked for."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def uniform(self, at: np.ndarray) -> np.ndarray:
        return self.rng.uniform(size=len(at))

    def exponential(self, at: np.ndarray) -> np.ndarray:
        return self.rng.exponential(size=len(at))

    def wald(self, at: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return self.rng.wald(mean, 1.0)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no pattern (the finaliser of SplitMix64; its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keyed:
    """A stream for each place by (seed, its key, a step): the n-th number of a place depends on nothing else."""

    def __init__(self, seed: int, keys: np.ndarray, step: int, copy: np.ndarray | int = 0):
        base = _scrambled(np.uint64(seed % (1 << 64)) + np.asarray(keys).astype(np.int64).view(np.uint64))
        base = _scrambled(base + np.uint64(step) + (np.asarray(copy).astype(np.uint64) << np.uint64(32)))
        self.base, self.used = base, np.zeros(len(base), np.uint64)

    def uniform(self, at: np.ndarray) -> np.ndarray:
        self.used[at] += np.uint64(1)
        x = _scrambled(self.base[at] + self.used[at] * np.uint64(0x9E3779B97F4A7C15))
        return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)

    def exponential(self, at: np.ndarray) -> np.ndarray:
        return -np.log(self.uniform(at))

    def normal(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.uniform(at))) * np.cos(2 * np.pi * self.uniform(at))

    def wald(self, at: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Inverse Gaussian draws of shape 1: a root of a chi-square draw, or its reflection."""
        c = mean * self.normal(at) ** 2
        x = mean + mean * c / 2 - mean / 2 * np.sqrt(4 * c + c * c)
        x = np.maximum(x, 1e-300)
        return np.where(self.uniform(at) <= mean / (mean + x), x, mean * mean / x)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.fromiter(map(math.erf, (x / math.sqrt(2)).tolist()), float, len(x)))


def _term(n: int, x: np.ndarray) -> np.ndarray:
    """The n-th term of the alternating series of the Jacobi density at ``x``."""
    k, out, below = n + 0.5, np.empty(len(x)), x <= CUT
    small = x[below]
    out[below] = (2 / (np.pi * small)) ** 1.5 * np.exp(-2 * k * k / small)
    out[~below] = np.exp(-k * k * np.pi**2 * x[~below] / 2)
    return np.pi * k * out


def _inverse_gaussian(mean_inverse: np.ndarray, rng: Source, places: np.ndarray) -> np.ndarray:
    """Draws of mean 1 / ``mean_inverse`` and shape 1, kept below the cut, with the numbers of ``places``."""
    out = np.empty(len(mean_inverse))
    todo = np.arange(len(out))
    while len(todo):
        z = mean_inverse[todo]
        wide = z < 1 / CUT
        x = np.empty(len(todo))
        ok = np.ones(len(todo), bool)
        if wide.any():  # a truncated chi-square piece, thinned
            own = places[todo[wide]]
            e1, e2 = rng.exponential(own), rng.exponential(own)
            good = e1 * e1 <= 2 * e2 / CUT
            draw = CUT / (1 + CUT * e1) ** 2
            x[wide] = draw
            ok[wide] = good & (rng.uniform(own) <= np.exp(-0.5 * z[wide] ** 2 * draw))
        if (~wide).any():
            mu = 1 / z[~wide]
            x[~wide] = rng.wald(places[todo[~wide]], mu)
            ok[~wide] = x[~wide] <= CUT
        out[todo[ok]] = x[ok]
        todo = todo[~ok]
    return out


def draw_one(z: np.ndarray, rng: np.random.Generator | Source) -> np.ndarray:
    """A PG(1, z) draw for each entry of ``z``."""
    rng = Sequence(rng) if isinstance(rng, np.random.Generator) else rng
    z = np.abs(np.asarray(z, float)) / 2
    rate = np.pi**2 / 8 + z * z / 2
    right = np.pi / (2 * rate) * np.exp(-rate * CUT)
    root = np.sqrt(1 / CUT)
    with np.errstate(over="ignore", invalid="ignore"):
        left = 2 * np.exp(-z) * (_normal_cdf(root * (CUT * z - 1)) + np.exp(2 * z) * _normal_cdf(-root * (CUT * z + 1)))
    left = np.where(np.isfinite(left), left, 2 * np.exp(-z))
    out = np.empty(len(z))
    todo = np.arange(len(z))
    while len(todo):
        tail = rng.uniform(todo) < right[todo] / (right[todo] + left[todo])
        x = np.empty(len(todo))
        x[tail] = CUT + rng.exponential(todo[tail]) / rate[todo[tail]]
        x[~tail] = _inverse_gaussian(z[todo[~tail]], rng, todo[~tail])
        total = _term(0, x)
        y = rng.uniform(todo) * total
        state, n = np.zeros(len(todo), int), 0  # 1 taken, -1 refused
        open_ = np.arange(len(todo))  # few need more than a term
        while len(open_):
            n += 1
            t = _term(n, x[open_])
            if n % 2:
                total[open_] -= t
                decided = y[open_] <= total[open_]
                state[open_[decided]] = 1
            else:
                total[open_] += t
                decided = y[open_] > total[open_]
                state[open_[decided]] = -1
            open_ = open_[~decided]
        out[todo[state == 1]] = x[state == 1] / 4
        todo = todo[state != 1]
    return out


def draw(n: np.ndarray, z: np.ndarray, rng: np.random.Generator | Source) -> np.ndarray:
    """A PG(n, z) draw for each entry, ``n`` positive integers: sums of PG(1, z) draws."""
    n = np.asarray(n).astype(int)
    owner = np.repeat(np.arange(len(n)), n)
    return np.bincount(owner, weights=draw_one(np.asarray(z, float)[owner], rng), minlength=len(n))
