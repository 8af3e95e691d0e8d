"""Sparse similarities of points and anchors (row_id, idx, w), and their graph-Laplacian normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.dense import TINY, local_weights
from heatloom.operators.anchors import Anchors
from heatloom.functions.arrow import lists, matrix
from heatloom.operators.neighbors import BATCH, nearest, nearest_anchors

NORMS = ("rw", "normalized", "cluster-normalized")


def lae_weights(points: DataFrame, u: np.ndarray, r: int = 3, tol: float = 1e-5, steps: int = 100) -> DataFrame:
    """Local anchor embedding: weights on the ``r`` nearest anchors that are convex and rebuild the point best."""
    if not 1 <= r <= len(u):
        raise ValueError(f"r must be between 1 and the number of anchors, {len(u)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = matrix(part.column(1), u.shape[1])
                idx, _ = nearest(x, u, r)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(idx), lists(local_weights(x, u[idx], tol, steps))], names=["row_id", "idx", "w"])

    return points.select("row_id", "x").mapInArrow(run, "row_id long, idx array<int>, w array<double>")


def se_weights(near: DataFrame, scale: float) -> DataFrame:
    """exp(-d2 / scale) of nearest anchors (row_id, idx, d2); scale is 4 eps^2, or a^2 times the mean d2."""
    return near.select("row_id", "idx", F.transform("d2", lambda d: F.exp(-d / F.lit(float(scale)))).alias("w"))


def mean_distance(near: DataFrame) -> float:
    """The mean of all stored squared distances."""
    total = F.aggregate("d2", F.lit(0.0), lambda acc, v: acc + v)
    row = near.agg(F.sum(total).alias("t"), F.sum(F.size("d2")).alias("n")).first()
    return row["t"] / row["n"]


def column_sums(z: DataFrame, s: int) -> np.ndarray:
    """Sum of the weights on each anchor; summed in the tasks first, a row per anchor reaches the driver."""
    pairs = z.select(F.explode(F.arrays_zip("idx", "w")).alias("e")).groupBy(F.col("e.idx").alias("a")).agg(F.sum("e.w").alias("t"))
    out = np.zeros(s)
    for r in pairs.collect():
        out[r["a"]] = r["t"]
    return out


def scale_columns(z: DataFrame, factor: np.ndarray, row_normalize: bool) -> DataFrame:
    """Weights times a factor of their anchor, then divided by the row's sum if asked for, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(1)[0])
            idx, w = matrix(batch.column(1), width).astype(int), matrix(batch.column(2), width)
            w = w * factor[idx]
            if row_normalize:
                w = w / (w.sum(1, keepdims=True) + TINY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(w)], names=["row_id", "idx", "w"])

    return z.select("row_id", "idx", "w").mapInArrow(run, "row_id long, idx array<int>, w array<double>")


def normalize(z: DataFrame, anchors: Anchors, gl: str = "rw") -> DataFrame:
    """Row-stochastic weights: "rw" divides by row sums; "normalized" by column sums first; "cluster-normalized" also
    multiplies by the anchors' cluster sizes."""
    if gl not in NORMS:
        raise ValueError(f"unknown normalisation {gl!r}; one of {', '.join(NORMS)}")
    s = len(anchors.u)
    if gl == "rw":
        factor = np.ones(s)
    else:
        factor = 1 / (column_sums(z, s) + TINY)
        if gl == "cluster-normalized":
            factor = factor * anchors.size
    return scale_columns(z, factor, True)


def cross_similarity_lae(points: DataFrame, anchors: Anchors, r: int = 3, gl: str = "rw", tol: float = 1e-5, steps: int = 100) -> DataFrame:
    return normalize(lae_weights(points, anchors.u, r, tol, steps), anchors, gl)


def cross_similarity_se(points: DataFrame, anchors: Anchors, r: int = 3, epsilon: float = 0.1, gl: str = "rw") -> DataFrame:
    return normalize(se_weights(nearest_anchors(points, anchors.u, r), 4 * epsilon**2), anchors, gl)
