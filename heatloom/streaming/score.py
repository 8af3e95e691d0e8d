"""Scores of points that arrive later, by a Nystrom model that was fitted on a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heatloom.functions.arrow import matrix
from heatloom.operators.neighbors import BATCH
from heatloom.operators.nystrom import Nystrom


def score_stream(points: DataFrame, model: Nystrom, mean: np.ndarray, spread: np.ndarray, floor: float) -> DataFrame:
    """row_id, mean and var of each arriving point (row_id, x); stateless, so it takes streams and tables alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                v = model.extend(matrix(part.column(1), model.u.shape[1]))
                var = np.einsum("nk,kl,nl->n", v, spread, v, optimize=True) + floor
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v @ mean), pa.array(var)], names=["row_id", "mean", "var"])

    return points.select("row_id", "x").mapInArrow(run, "row_id long, mean double, var double")
