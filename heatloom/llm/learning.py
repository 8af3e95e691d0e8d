"""Small learners that are fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of at most ``rows`` labelled documents that aren't held out, the first by a hash of their ids.

    An id with several labels counts as 1 if any of them is.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(rows)


@dataclass(frozen=True)
class Logistic:
    """A logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float | np.ndarray = 1.0, steps: int = 50) -> Logistic:
    """Newton's method with a ridge penalty, one or one for each feature; with one class or none, the smoothed base rate for every row."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    d = x.shape[1]
    rate = (float(w @ y) + 1) / (float(w.sum()) + 2)
    if len(np.unique(y)) < 2:
        return Logistic(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(rate / (1 - rate))))
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    scale[scale < 1e-9] = 1.0
    design = np.c_[(x - mean) / scale, np.ones(len(y))]
    beta = np.zeros(d + 1)
    beta[-1] = np.log(rate / (1 - rate))
    penalty = np.r_[np.full(d, ridge), 1e-6]

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(w @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ b**2)

    now = loss(beta)
    for _ in range(steps):
        p = sigmoid(design @ beta)
        grad = design.T @ (w * (p - y)) + penalty * beta
        hess = (design * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while (new := loss(beta - size * step)) > now and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if abs(now - new) < 1e-9 * (1 + abs(now)):
            break
        now = new
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))
