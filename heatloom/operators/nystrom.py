"""A dense kernel on anchors, its spectrum, and the extension to any row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heatloom.functions.dense import TINY, squared_distances, top_eigen
from heatloom.functions.arrow import lists, matrix
from heatloom.operators.neighbors import BATCH


def graph_spectrum(z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the density-corrected random walk on a dense similarity, and its row sums.

    Vectors are scaled to the root of the number of rows.
    """
    d = z.sum(1) + TINY
    a = z / d[:, None] / d
    root = np.sqrt(a.sum(1) + TINY)
    values, vectors = top_eigen(a / root[:, None] / root, k)
    vectors = vectors / root[:, None]
    return values, vectors * (np.sqrt(len(z)) / np.sqrt((vectors**2).sum(0))), d


@dataclass(frozen=True)
class Nystrom:
    """All that extends a spectrum from anchors to rows; small enough to send to every task."""

    u: np.ndarray
    scale: float
    values: np.ndarray
    vectors: np.ndarray
    density: np.ndarray

    @classmethod
    def build(cls, u: np.ndarray, a2: float, k: int = -1) -> Nystrom:
        d2 = squared_distances(u, u)
        scale = a2 * d2.mean()
        values, vectors, density = graph_spectrum(np.exp(-d2 / scale), len(u) if k < 0 else min(k, len(u)))
        return cls(u, scale, values, vectors, density)

    def weights(self, x: np.ndarray) -> np.ndarray:
        """Row-stochastic, density-corrected similarities of rows and anchors."""
        z = np.exp(-squared_distances(x, self.u) / self.scale)
        a = z / (z.sum(1, keepdims=True) + TINY) / self.density
        return a / (a.sum(1, keepdims=True) + TINY)

    def extend(self, x: np.ndarray) -> np.ndarray:
        return self.weights(x) @ self.vectors / (np.abs(self.values) + TINY)

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        """Vectors of a batch of row_id and x (and more)."""
        parts = (batch.column(1).slice(at, BATCH) for at in range(0, batch.num_rows, BATCH))
        return np.vstack([self.extend(matrix(part, self.u.shape[1])) for part in parts])

    def vectors_of(self, points: DataFrame) -> DataFrame:
        """row_id and v of every point; stateless, so streams can be extended too."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    yield pa.RecordBatch.from_arrays([part.column(0), lists(self.extend(matrix(part.column(1), self.u.shape[1])))], names=["row_id", "v"])

        return points.select("row_id", "x").mapInArrow(run, "row_id long, v array<double>")
