"""Negative log likelihoods of predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.dense import TINY
from heatloom.functions.gp import sigmoid

#: Fixed value: added to a likelihood before its logarithm.
FLOOR = 1e-2


def regression_nll(rows: DataFrame, mean: str = "mean", var: str = "var", target: str = "y") -> DataFrame:
    """nll: half the mean of squared error over variance plus log variance, and half of log 2 pi."""
    error = F.col(target) - F.col(mean)
    return rows.agg((0.5 * (F.avg(error * error / F.col(var) + F.log(F.col(var) + TINY)) + math.log(2 * math.pi))).alias("nll"))


def binary_nll(rows: DataFrame, mean: str = "mean", var: str = "var", target: str = "y", samples: int = 100, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """nll of 0/1 targets under latent normals: the mean likelihood of ``samples`` draws (0 takes 32 fixed nodes of Gauss and Hermite).

    A row's draws depend on its id and the seed alone.
    """
    nodes, weights = np.polynomial.hermite_e.hermegauss(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m, v, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sd = np.sqrt(np.maximum(v, 0.0))
            if samples:
                e = np.stack([np.random.default_rng([seed, abs(int(i)), int(i) < 0]).standard_normal(samples) for i in ids]) if len(ids) else np.zeros((0, samples))
                pi = sigmoid(m[:, None] + sd[:, None] * e).mean(1)
            else:
                pi = sigmoid(m[:, None] + sd[:, None] * nodes) @ (weights / weights.sum())
            yield pa.RecordBatch.from_arrays([pa.array(-np.log(np.where(y > 0.5, pi, 1 - pi) + FLOOR))], names=["l"])

    return rows.select(F.col(id_col).cast("long"), F.col(mean).cast("double"), F.col(var).cast("double"), F.col(target).cast("double")).mapInArrow(run, "l double").agg(F.avg("l").alias("nll"))


def multinomial_nll(rows: DataFrame, mean: str = "mean", var: str = "var", target: str = "y", samples: int = 100, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """nll: the sum over classes of each one's binary likelihoods; mean and var are arrays by class."""
    each = rows.select(F.col(id_col).alias("row_id"), F.col(target).alias("label"), F.posexplode(F.arrays_zip(F.col(mean).alias("m"), F.col(var).alias("v"))).alias("class", "p"))
    flat = each.select("row_id", F.col("p.m").alias("mean"), F.col("p.v").alias("var"), (F.col("label") == F.col("class")).cast("double").alias("y"))
    classes = each.agg((F.max("class") + 1).alias("j"))
    return binary_nll(flat, "mean", "var", "y", samples, seed, "row_id").crossJoin(classes).select((F.col("nll") * F.col("j")).alias("nll"))  # one row each


def negative_log_likelihood(rows: DataFrame, kind: str = "regression", **options) -> DataFrame:
    found = {"regression": regression_nll, "binary": binary_nll, "multinomial": multinomial_nll}
    if kind not in found:
        raise ValueError(f"unknown type {kind!r}; one of {', '.join(found)}")
    return found[kind](rows, **options)
