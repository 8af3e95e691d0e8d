"""Spectra and moments of many bandwidths at once: stacked sums, so that jobs don't grow with the number of bandwidths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.arrow import lists, matrix, sum_arrays
from heatloom.functions.dense import TINY
from heatloom.functions.gp import Moments
from heatloom.operators.anchors import Anchors
from heatloom.operators.nystrom import Nystrom
from heatloom.operators.qr import triangle
from heatloom.operators.spectrum import Spectrum, projection

#: Values of stacked sums that a task holds at most (32 MB); more bandwidths take another pass.
STACKED = 4_000_000


def passes(sizes: list[int]) -> Iterator[list[int]]:
    """The numbers of the bandwidths that are summed together, by the values that each needs."""
    group, held = [], 0
    for a, size in enumerate(sizes):
        if group and held + size > STACKED:
            yield group
            group, held = [], 0
        group.append(a)
        held += size
    if group:
        yield group


def stacked_moments(rows: DataFrame, features: list[Callable[[pa.RecordBatch], np.ndarray]], sizes: list[int]) -> list[Moments]:
    """V'V, V'Y, Y'Y and the count of ``rows`` for each function from rows to vectors V; targets are in the last column, as arrays."""
    q = rows.select(F.max(F.size(rows.columns[-1]))).first()[0]
    if not q or q < 0:
        raise ValueError("there are no training rows" if q is None else "training rows must have labels")
    out: list[Moments] = []
    for group in passes([k * (k + q) + 2 for k in sizes]):

        def run(batches: Iterator[pa.RecordBatch], group: list[int] = group) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    t = matrix(batch.column(batch.num_columns - 1), q)
                    vectors = (features[a](batch) for a in group)
                    total = total + np.concatenate([np.r_[(v.T @ v).ravel(), (v.T @ t).ravel(), (t * t).sum(), len(v)] for v in vectors])
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["a"])

        total = sum_arrays(rows.mapInArrow(run, "a array<double>"))
        if np.isnan(total).any():
            raise ValueError("training rows must have labels")
        at = 0
        for a in group:
            k = sizes[a]
            part, at = total[at : at + k * (k + q) + 2], at + k * (k + q) + 2
            out.append(Moments(part[: k * k].reshape(k, k), part[k * k : -2].reshape(k, q), float(part[-2]), int(part[-1])))
    return out


def targets(points: DataFrame) -> DataFrame:
    """row_id and ys, the targets of the training rows as arrays."""
    y = F.col("y") if dict(points.dtypes)["y"].startswith("array") else F.array(F.col("y").cast("double"))
    return points.where("is_train").select("row_id", y.alias("ys"))


class SeGrid:
    """Spectra of squared-exponential weights for several scales, from distances to the nearest anchors (row_id, idx, d2).

    One job sums the columns of all scales (none for "rw"), one their Gram matrices, whose entries lie at the same places
    for every scale, and one the moments of the training rows. Only values that a Gram matrix can't tell take jobs of their own.
    """

    def __init__(self, near: DataFrame, anchors: Anchors, scales: list[float], gl: str, k: int, root: bool) -> None:
        self.near, self.scales, self.root = near.select("row_id", "idx", "d2"), scales, root
        s = len(anchors.u)
        self.factors = [np.ones(s)] * len(scales)
        if gl != "rw":
            sums = self._sums(s)
            self.factors = [(anchors.size if gl == "cluster-normalized" else 1.0) / (c + TINY) for c in sums]
        n, found = near.count(), self._squares(s)
        exact = lambda a: lambda scale: triangle(self._normalized(a), scale)
        self.spectra = [projection(columns, squares, n, k, exact(a)) for a, (columns, squares) in enumerate(found)]
        self._moments: list[Moments] | None = None  # of all scales

    def _weights(self, a: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        scale, factor = self.scales[a], self.factors[a]

        def weigh(idx: np.ndarray, d2: np.ndarray) -> np.ndarray:
            w = np.exp(-d2 / scale) * factor[idx]
            return w / (w.sum(1, keepdims=True) + TINY)

        return weigh

    def _sums(self, s: int) -> np.ndarray:
        """Sums of the plain weights on each anchor, a row for each scale."""
        scales = self.scales

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(scales), s))
            for batch in batches:
                if batch.num_rows:
                    width = len(batch.column(0)[0])
                    idx, d2 = matrix(batch.column(0), width).astype(int).ravel(), matrix(batch.column(1), width).ravel()
                    for a, scale in enumerate(scales):
                        total[a] += np.bincount(idx, weights=np.exp(-d2 / scale), minlength=s)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["a"])

        return sum_arrays(self.near.select("idx", "d2").mapInArrow(run, "a array<double>")).reshape(len(scales), s)

    def _squares(self, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Column sums and Z'Z of each scale's normalised weights; column sums lie behind the pairs, at s * s + anchor."""
        weighers = [self._weights(a) for a in range(len(self.scales))]
        names = [f"g{a}" for a in range(len(weighers))]
        schema = ", ".join(["k long", *[f"{c} double" for c in names]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                width = len(batch.column(0)[0])
                idx, d2 = matrix(batch.column(0), width).astype(np.int64), matrix(batch.column(1), width)
                keys = np.r_[(idx[:, :, None] * s + idx[:, None, :]).ravel(), s * s + idx.ravel()]
                found, at = np.unique(keys, return_inverse=True)
                sums = []
                for weigh in weighers:
                    w = weigh(idx, d2)
                    sums.append(pa.array(np.bincount(at.ravel(), weights=np.r_[(w[:, :, None] * w[:, None, :]).ravel(), w.ravel()])))
                yield pa.RecordBatch.from_arrays([pa.array(found), *sums], names=["k", *names])

        got = self.near.select("idx", "d2").mapInArrow(run, schema).groupBy("k").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        key, out = got.column("k").to_numpy(), []
        for c in names:
            flat = np.zeros(s * s + s)
            flat[key] = got.column(c).to_numpy()
            out.append((flat[s * s :], flat[: s * s].reshape(s, s)))
        return out

    def _normalized(self, a: int) -> DataFrame:
        weigh = self._weights(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    width = len(batch.column(1)[0])
                    w = weigh(matrix(batch.column(1), width).astype(int), matrix(batch.column(2), width))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(w)], names=["row_id", "idx", "w"])

        return self.near.mapInArrow(run, "row_id long, idx array<int>, w array<double>")

    def _features(self, a: int) -> Callable[[pa.RecordBatch], np.ndarray]:
        """Vectors of rows (row_id, idx, d2) for one scale."""
        weigh, project = self._weights(a), self.spectra[a][1]

        def vectors(batch: pa.RecordBatch) -> np.ndarray:
            width = len(batch.column(1)[0])
            idx, d2 = matrix(batch.column(1), width).astype(int), matrix(batch.column(2), width)
            w = weigh(idx, d2)
            out = np.zeros((len(w), project.shape[1]))
            for c in range(width):
                out += w[:, c : c + 1] * project[idx[:, c]]
            return out

        return vectors

    def spectrum(self, a: int) -> Spectrum:
        f, sigma = self._features(a), self.spectra[a][0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists(f(batch))], names=["row_id", "v"])

        return Spectrum(sigma if self.root else sigma**2, self.near.mapInArrow(run, "row_id long, v array<double>"), moments=lambda points: self.moments(points, a))

    def moments(self, points: DataFrame, a: int) -> Moments:
        """Of the training rows for one scale; all scales are summed when the first is asked for."""
        if self._moments is None:
            rows = self.near.join(targets(points), "row_id")
            count = range(len(self.scales))
            self._moments = stacked_moments(rows, [self._features(b) for b in count], [len(self.spectra[b][0]) for b in count])
        return self._moments[a]


class NystromGrid:
    """Anchor graphs of several bandwidths, and moments of the training rows for all of them in one job; threads may share it."""

    def __init__(self, u: np.ndarray, grid: list[float], k: int, train: DataFrame) -> None:
        self.grid, self.train, self.model = grid, train, cache(lambda a2: Nystrom.build(u, a2, k))
        self._lock, self._moments = Lock(), None

    def moments(self, points: DataFrame, a2: float) -> Moments:
        with self._lock:
            if self._moments is None:
                models = [self.model(b) for b in self.grid]
                rows = self.train.select("row_id", "x").join(targets(points), "row_id")
                self._moments = stacked_moments(rows, [n.features for n in models], [len(n.values) for n in models])
        return self._moments[self.grid.index(a2)]
