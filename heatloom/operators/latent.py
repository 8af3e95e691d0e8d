"""Classification where training rows stay in tasks: Laplace-Newton and Polya-Gamma sweeps by sums of the number of eigenpairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import gp, polyagamma
from heatloom.functions.arrow import matrix, sum_arrays
from heatloom.functions.dense import cholesky, minimize_log_many, solve_chol
from heatloom.operators.stored import stored

#: Sweeps that a task repeats from stored variables before they are stored anew.
STORED_SWEEPS = 10


@dataclass(frozen=True)
class Search:
    """A Newton search: the prior's weights by eigenpair, the ridge, and what each step so far sent to the rows."""

    lam: np.ndarray
    ridge: float
    steps: tuple[tuple[np.ndarray, np.ndarray], ...] = ()


@dataclass(frozen=True)
class Sums:
    """What a pass brings back: sums at the latent values that a search has come to, and parts of the evidence of its last step."""

    second: np.ndarray  # V'(W/d)V with d = 1 + ridge W
    target: np.ndarray  # V'b with b = W f + Y - N pi
    scaled: np.ndarray  # V'(W/d)b
    gradient: np.ndarray  # V'(Y - N pi)
    quadratic: float  # a'f
    likelihood: float
    log_diagonal: float  # of the weights before the last step
    moved: float

    @classmethod
    def of(cls, flat: np.ndarray, k: int) -> Sums:
        return cls(flat[: k * k].reshape(k, k), *flat[k * k : k * k + 3 * k].reshape(3, k), *(float(x) for x in flat[k * k + 3 * k :]))


def replay(v: np.ndarray, y: np.ndarray, trials: np.ndarray, search: Search) -> tuple[np.ndarray, tuple]:
    """The latent values of rows after all steps of a search, and (a'f, log likelihood, sum of log d, distance moved) of the last."""
    f, last = np.zeros(len(y)), (0.0, 0.0, 0.0, np.inf)
    for alpha, u in search.steps:
        pi = gp.sigmoid(f)
        weight = trials * pi * (1 - pi)
        d = 1 + search.ridge * weight
        a = (weight * f + y - trials * pi) / d - weight / d * (v @ u)
        new = v @ alpha + search.ridge * a
        like = (y * gp.log_sigmoid(new) + (trials - y) * gp.log_sigmoid(-new)).sum()
        last = float(a @ new), float(like), float(np.log(d).sum()), float(np.abs(new - f).sum())
        f = new
    return f, last


class TrainingRows:
    """The training rows' vectors, labels and trials, kept by the tasks; only sums of their products come to the driver.

    A latent value is a function of a row and of what each Newton step sent to all rows, so tasks work it out again instead
    of storing it: a lost executor costs no more than its rows.
    """

    def __init__(self, points: DataFrame, vectors: DataFrame, k: int, of_class: int | None = None):
        trials = F.col("n_trials").cast("double") if "n_trials" in points.columns else F.lit(1.0)
        y = F.col("y").cast("double") if of_class is None else (F.col("y") == of_class).cast("double")
        labels = points.where("is_train").select("row_id", y.alias("y"), trials.alias("trials"))
        self.k = k
        self.table = vectors.select("row_id", "v").join(labels, "row_id").select("row_id", "y", "trials", "v").persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def rows(self) -> int:
        return self.table.count()

    def release(self) -> None:
        self.table.unpersist()

    def sums(self, searches: list[Search]) -> list[Sums]:
        """One pass for all ``searches``."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, trials, v = batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), k)
                parts = []
                for s in searches:
                    f, last = replay(v, y, trials, s)
                    pi = gp.sigmoid(f)
                    weight, gap = trials * pi * (1 - pi), y - trials * pi
                    b, share = weight * f + gap, weight / (1 + s.ridge * weight)
                    moved = last if s.steps else (0.0, 0.0, 0.0, 0.0)
                    parts.append(np.r_[(v.T @ (v * share[:, None])).ravel(), v.T @ b, v.T @ (share * b), v.T @ gap, moved])
                flat = np.concatenate(parts)
                total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["a"])

        flat = sum_arrays(self.table.mapInArrow(run, "a array<double>"))
        return [Sums.of(x, k) for x in flat.reshape(len(searches), -1)]

    def modes(self, searches: list[Search], tol: float = 1e-5, most: int = 100) -> list[tuple[float, Search, Sums]]:
        """Log evidence, finished search and sums at the mode for each; all that are not done share their passes. NaN for a failed factorisation."""
        out: list = [None] * len(searches)
        live, dets, before = list(range(len(searches))), [0.0] * len(searches), [np.inf] * len(searches)
        searches = list(searches)
        for turn in range(most + 1):
            for i, got in zip(list(live), self.sums([searches[i] for i in live]), strict=True):
                s, evidence = searches[i], -np.inf
                if turn:
                    evidence = -0.5 * got.quadratic + got.likelihood - 0.5 * got.log_diagonal - dets[i]
                    if gp.settled(got.moved, before[i], self.rows, tol) or turn == most:
                        out[i] = (evidence, s, got)
                        live.remove(i)
                        continue
                    before[i] = got.moved
                half = np.sqrt(s.lam)
                h = s.lam * got.target
                try:
                    lower = cholesky(np.eye(self.k) + half[:, None] * got.second * half)
                except np.linalg.LinAlgError:
                    out[i] = (float("nan"), s, got)
                    live.remove(i)
                    continue
                right = got.second @ h + s.ridge * got.scaled
                g = half * solve_chol(lower, half * right)
                alpha = s.lam * (got.target - right + got.second @ g)
                searches[i] = Search(s.lam, s.ridge, (*s.steps, (alpha, h - g)))
                dets[i] = float(np.log(np.diag(lower)).sum())
            if not live:
                break
        return out

    def latent(self, search: Search) -> DataFrame:
        """(row_id, f): the rows' latent values after all steps of ``search``."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    f, _ = replay(matrix(batch.column(3), k), batch.column(1).to_numpy(), batch.column(2).to_numpy(), search)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], names=["row_id", "f"])

        return self.table.mapInArrow(run, "row_id long, f double")

    def best_time(self, values: np.ndarray, sigma: float, approach: str) -> tuple[float, float]:
        """As ``gp.best_time``: the times that a search may come to are tried in the same passes."""
        posterior = gp.check_approach(approach)

        def f(times: list[float]) -> list[float]:
            found = self.modes([Search(gp.heat(values, t), sigma) for t in times])
            return [np.inf if np.isnan(e) else -e + (gp.t_prior(t, gp.LOGIT_T)[0] if posterior else 0.0) for t, (e, _, _) in zip(times, found, strict=True)]

        t, objective = minimize_log_many(f, 10.0, gp.T_LOW)
        return t, -objective

    def gibbs(self, lam: np.ndarray, sigma: float, sweeps: int, seed: int, average: bool = False) -> DataFrame:
        """The rows with their Polya-Gamma variables (omega) after ``sweeps`` rounds, or the mean of the later half.

        A round draws the coefficients of the eigenpairs from their normal distribution given the variables (K-sized sums and a
        K-sized draw), then each row's latent value given those, and its variable given that. A row's numbers depend on
        (seed, row_id, round) alone, so that partitions and lost tasks change nothing.
        """
        k, half, later = self.k, np.sqrt(lam), sweeps // 2
        state = self.table.withColumns({"omega": F.lit(1.0), "total": F.lit(0.0)})
        schema, names = "row_id long, y double, trials double, v array<double>, omega double, total double", state.columns

        def advanced(batch: pa.RecordBatch, draws: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
            ids, y, trials, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), k)
            omega, total = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            basis, n = v * half, np.maximum(trials, 1).astype(int)
            owner = np.repeat(np.arange(len(ids)), n)
            copy = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            for sweep, beta in draws:
                spread = sigma / (1 + sigma * omega)
                mean = (basis @ beta + sigma * (y - trials / 2)) / (1 + sigma * omega)
                f = mean + np.sqrt(spread) * polyagamma.Keyed(seed, ids, 2 * sweep).normal(np.arange(len(ids)))
                one = polyagamma.draw_one(f[owner], polyagamma.Keyed(seed, ids[owner], 2 * sweep + 1, copy))
                omega = np.maximum(np.bincount(owner, one, len(ids)), 1e-12)
                total = total + omega * (sweep >= later)
            return basis, y - trials / 2, omega, total

        def passed(draws: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            """basis'(1/D)basis and basis'(1/D)(kappa/omega) for D = sigma + 1/omega."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        basis, kappa, omega, _ = advanced(batch, draws)
                        scaled = basis / (sigma + 1 / omega)[:, None]
                        yield pa.RecordBatch.from_arrays([pa.array([np.r_[(basis.T @ scaled).ravel(), scaled.T @ (kappa / omega)].tolist()], pa.list_(pa.float64()))], names=["a"])

            flat = sum_arrays(state.mapInArrow(run, "a array<double>"))
            return flat[: k * k].reshape(k, k), flat[k * k :]

        def moved(draws: list[tuple[int, np.ndarray]]) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        _, _, omega, total = advanced(batch, draws)
                        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(omega), pa.array(total)], names=names)

            return stored(state.mapInArrow(run, schema))

        draws: list[tuple[int, np.ndarray]] = []
        for sweep in range(sweeps):
            inner, right = passed(draws)
            lower = cholesky(np.eye(k) + inner)
            noise = np.random.default_rng([seed, sweep]).standard_normal(k)
            draws.append((sweep, solve_chol(lower, right) + np.linalg.solve(lower.T, noise)))
            if len(draws) == STORED_SWEEPS or sweep == sweeps - 1:
                state, draws = moved(draws), []
        if average and sweeps:
            state = state.withColumn("omega", F.col("total") / (sweeps - later))
        return state.drop("total")

    def pg_weights(self, state: DataFrame, lam: np.ndarray, sigma: float) -> tuple[np.ndarray, DataFrame]:
        """What labels of all rows follow (as ``gp.pg_weights`` through the eigenpairs), and each training row's own weight."""
        k, half = self.k, np.sqrt(lam)

        def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y, trials, v, omega = batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), k), batch.column(4).to_numpy()
            basis = v * half
            d = sigma + 1 / omega
            return basis, basis / d[:, None], (y - trials / 2) / omega / d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    basis, scaled, own = parts(batch)
                    yield pa.RecordBatch.from_arrays([pa.array([np.r_[(basis.T @ scaled).ravel(), basis.T @ own].tolist()], pa.list_(pa.float64()))], names=["a"])

        flat = sum_arrays(state.mapInArrow(run, "a array<double>"))
        inner, right = flat[: k * k].reshape(k, k), flat[k * k :]
        solved = solve_chol(cholesky(np.eye(k) + inner), right)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, scaled, own = parts(batch)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own - scaled @ solved)], names=["row_id", "own"])

        return half * (right - inner @ solved), state.mapInArrow(rows, "row_id long, own double")

    def fit(self, values: np.ndarray, sigma: float, approach: str, sweeps: int, seed: int, ridge_in_posterior: bool = True, average: bool = False, best: tuple[float, float] | None = None) -> tuple[gp.LogitFit, DataFrame]:
        """As ``gp.fit_logit``, and (row_id, own): the training rows' own weights, which times sigma ridge adds to their labels; ``best`` is what ``best_time`` gave, if it is known."""
        t, objective = best or self.best_time(values, sigma, approach)
        lam = gp.heat(values, t)
        _, _, at = self.modes([Search(lam, sigma if ridge_in_posterior else 0.0)])[0]
        half = np.sqrt(lam)
        lower = cholesky(np.eye(self.k) + half[:, None] * at.second * half)
        spread = half[:, None] * solve_chol(lower, np.eye(self.k)) * half
        label, own = self.pg_weights(self.gibbs(lam, sigma, sweeps, seed, average), lam, sigma)
        return gp.LogitFit(t, objective, lam * at.gradient, spread, label, np.zeros(0)), own
