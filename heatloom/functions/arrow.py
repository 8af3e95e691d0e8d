"""Blocks of rows between Arrow columns and numpy, and sums of them over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array<double> column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(rows).ravel()), rows.shape[1]).cast(pa.list_(pa.from_numpy_dtype(rows.dtype)))


def sum_arrays(rows: DataFrame) -> np.ndarray:
    """The sum of the one array<double> column of ``rows``, in two levels of tasks before the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in batch.column(0):
                v = np.asarray(a.values)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["a"])

    first = rows.mapInArrow(run, "a array<double>")
    parts = first.repartition(16).mapInArrow(run, "a array<double>").collect()
    return np.sum([p["a"] for p in parts], axis=0)
