"""Spectra of sparse similarities through a Gram matrix of anchors, eigenmaps, and heat kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.dense import TINY, top_eigen
from heatloom.functions.gp import Moments, heat
from heatloom.functions.arrow import lists, matrix
from heatloom.operators.qr import QR_ANCHORS, dense, right_vectors, triangle
from heatloom.operators.weights import column_sums

#: Singular values below this share of the largest are noise in a Gram matrix, which squares the condition number. Where a
#: wanted one is below the second share, the weights are decomposed without squaring.
NEGLIGIBLE, PRECISE = 1e-7, 1e-4
#: Values of one side's vectors up to which that side goes to all tasks (16 MB); where both sides are dealt, rows of a block, blocks
#: of a side at most (beyond, blocks grow), and pairs that are put out at once.
SENT_VALUES, KERNEL_BLOCK, MOST_BLOCKS, KERNEL_CELLS = 2_000_000, 4096, 256, 400_000


#: Points by anchors (a dense matrix of 80 MB) up to which weights are decomposed on the driver: jobs would cost more than the arithmetic.
LOCAL_VALUES = 10_000_000


@dataclass(frozen=True)
class Spectrum:
    """Similarity eigenvalues (descending), and row_id and v for every point; for few points also on the driver (ids ascending, v)."""

    values: np.ndarray
    vectors: DataFrame
    local: tuple[np.ndarray, np.ndarray] | None = None
    held: tuple[DataFrame, ...] = ()  # persisted tables that the vectors are computed from
    moments: Callable[[DataFrame], Moments] | None = None  # of training rows, where those of several spectra are summed at once


@dataclass(frozen=True)
class LocalWeights:
    """Sparse weights on the driver: ids ascending, anchors and weights of each row."""

    ids: np.ndarray
    idx: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, z: DataFrame, value: str = "w") -> LocalWeights:
        got = z.select("row_id", "idx", value).toArrow().combine_chunks()
        ids = got.column(0).to_numpy()
        order, (idx, w) = np.argsort(ids, kind="stable"), (got.column(c).chunk(0) for c in (1, 2))
        width = len(idx[0])
        return cls(ids[order], idx.flatten().to_numpy().reshape(-1, width)[order], matrix(w, width)[order])

    def normalized(self, size: np.ndarray, gl: str) -> LocalWeights:
        w = self.w
        if gl != "rw":
            sums = np.bincount(self.idx.ravel(), weights=w.ravel(), minlength=len(size)) + TINY
            w = w * ((size if gl == "cluster-normalized" else 1.0) / sums)[self.idx]
        return LocalWeights(self.ids, self.idx, w / (w.sum(1, keepdims=True) + TINY))

    def projection(self, s: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.bincount(self.idx.ravel(), weights=self.w.ravel(), minlength=s)
        rows = dense(self.idx.astype(np.int64), self.w, s)
        return projection(sums, rows.T @ rows, len(self.ids), k, lambda scale: np.linalg.qr(rows * scale, mode="r"))

    def spectrum(self, s: int, k: int, root: bool) -> tuple[np.ndarray, np.ndarray]:
        """Values and the vectors of all rows."""
        sigma, project = self.projection(s, k)
        return sigma if root else sigma**2, self.times(project)

    def times(self, right: np.ndarray) -> np.ndarray:
        """The weights times a dense matrix."""
        return sum(self.w[:, c : c + 1] * right[self.idx[:, c]] for c in range(self.w.shape[1]))


def projection(sums: np.ndarray, squares: np.ndarray, n: int, k: int, exact: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of A = Z diag(sums)^-1/2 and what turns a row of Z into its scaled left vectors.

    ``squares`` is Z'Z. If a value that is wanted is too small for it, ``exact`` gives a triangle of Z with scaled columns.
    """
    scale = 1 / np.sqrt(np.abs(sums) + TINY)
    wanted = len(sums) if k < 0 else min(k, len(sums))
    found, right = top_eigen(squares * scale[:, None] * scale, wanted)
    sigma = np.sqrt(np.maximum(found, 0.0))
    if sigma[-1] < PRECISE * sigma[0] and len(sums) <= QR_ANCHORS:
        sigma, right = right_vectors(exact(scale), wanted)
    keep = sigma > (0.0 if len(sums) <= QR_ANCHORS else NEGLIGIBLE * max(float(sigma[0]), TINY))
    return sigma[keep], scale[:, None] * right[:, keep] / sigma[keep] * np.sqrt(n)


def gram_pairs(z: DataFrame) -> DataFrame:
    """(i, j, g): the entries of Z'Z, summed by task before the shuffle."""
    pairs = z.select(F.arrays_zip("idx", "w").alias("e")).select(F.explode("e").alias("p"), "e").select("p", F.explode("e").alias("q"))
    return pairs.groupBy(F.col("p.idx").alias("i"), F.col("q.idx").alias("j")).agg(F.sum(F.col("p.w") * F.col("q.w")).alias("g"))


def gram(z: DataFrame, s: int) -> np.ndarray:
    """Z'Z on the driver: anchors by anchors, whatever the number of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(0)[0])
            idx, w = matrix(batch.column(0), width).astype(np.int64), matrix(batch.column(1), width)
            keys = (idx[:, :, None] * s + idx[:, None, :]).ravel()
            found, at = np.unique(keys, return_inverse=True)
            sums = np.bincount(at.ravel(), weights=(w[:, :, None] * w[:, None, :]).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums)], names=["k", "g"])

    out = np.zeros(s * s)
    got = z.select("idx", "w").mapInArrow(run, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).toArrow()
    out[got.column("k").to_numpy()] = got.column("g").to_numpy()
    return out.reshape(s, s)


def spectrum_from_weights(z: DataFrame, s: int, k: int = -1, root: bool = False) -> Spectrum:
    """Left singular vectors of A = Z diag(colsum)^-1/2 times the root of the number of rows, with values sigma^2 (sigma if ``root``).

    A'A is summed over the points and decomposed on the driver; a second pass multiplies each row by the
    right vectors. ``k`` below 0 or above the rank takes all there are. Values down to 1e-12 of the largest are right (1e-7
    beyond 4000 anchors): where squares can't tell a wanted one, a tree of QR decompositions over tasks does.
    """
    n = z.count()
    local = LocalWeights.of(z) if n * s <= LOCAL_VALUES else None
    sigma, project = local.projection(s, k) if local else projection(column_sums(z, s), gram(z, s), n, k, lambda scale: triangle(z, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(1)[0])
            idx, w = matrix(batch.column(1), width).astype(int), matrix(batch.column(2), width)
            v = np.zeros((len(w), project.shape[1]))
            for c in range(width):
                v += w[:, c : c + 1] * project[idx[:, c]]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(v)], names=["row_id", "v"])

    vectors = z.select("row_id", "idx", "w").mapInArrow(run, "row_id long, v array<double>")
    return Spectrum(sigma if root else sigma**2, vectors, (local.ids, local.times(project)) if local else None)


def heat_kernel(left: DataFrame, right: DataFrame, values: np.ndarray, t: float, k: int = -1) -> DataFrame:
    """(i, j, h): sum over eigenpairs of v_i exp(-t (1 - value)) v_j for all rows of ``left`` and of ``right`` (row_id, v).

    A ``right`` of few vectors goes to the tasks. Otherwise both sides are dealt to blocks, and tasks take pairs of
    blocks, so that no task or driver holds a side whole. The result has as many rows as both sides multiplied.
    """
    k = len(values) if k < 0 else min(k, len(values))
    n, weight = right.count(), heat(values[:k], t)
    if n * k > SENT_VALUES:
        return _kernel_by_blocks(left, right, weight, left.count(), n)
    got = right.select("row_id", "v").toArrow().combine_chunks()
    if not n:
        return left.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(0.0).alias("h")).limit(0)
    order = np.argsort(got.column(0).chunk(0).to_numpy(), kind="stable")
    ids, weighed = got.column(0).chunk(0).to_numpy()[order], matrix(got.column(1).chunk(0), len(got.column(1)[0]))[order, :k] * weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = matrix(part.column(1), len(part.column(1)[0]))[:, :k]
                yield pa.RecordBatch.from_arrays([*_pairs(part.column(0).to_numpy(), ids), pa.array((v @ weighed.T).ravel())], names=["i", "j", "h"])

    return left.select("row_id", "v").mapInArrow(run, "i long, j long, h double")


def _pairs(i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i)))]


def _kernel_blocks(side: DataFrame, rows: int, k: int) -> DataFrame:
    """ids and v (``k`` entries of each id in turn) of blocks of ``side``, a partition for each block or a few."""
    blocks = min(-(-rows // max(1, min(KERNEL_BLOCK, SENT_VALUES // k))), MOST_BLOCKS)

    def pack(x: pa.Table) -> pa.Table:
        ids, v = x["row_id"].to_numpy(), matrix(x["v"].combine_chunks(), len(x["v"][0]))[:, :k]
        return pa.table({"ids": lists(ids[None, :]), "v": lists(v.reshape(1, -1))})

    placed = side.select("row_id", "v", F.pmod(F.xxhash64("row_id"), F.lit(max(blocks, 1))).alias("block"))
    return placed.groupBy("block").applyInArrow(pack, "ids array<long>, v array<double>").repartition(max(blocks, 1))


def _kernel_by_blocks(left: DataFrame, right: DataFrame, weight: np.ndarray, rows: int, columns: int) -> DataFrame:
    """The kernel of two large sides, from each pair of their blocks; a side is shuffled once, not once for each block of the other."""
    k = len(weight)
    here = _kernel_blocks(left, rows, k).toDF("i", "v")
    there = _kernel_blocks(right, columns, k).toDF("j", "w").hint("shuffle_replicate_nl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, v, j, w = (c[row].values.to_numpy() for c in batch.columns)
                weighed, step = (w.reshape(len(j), k) * weight).T, max(1, KERNEL_CELLS // len(j))
                for at in range(0, len(i), step):
                    h = v.reshape(len(i), k)[at : at + step] @ weighed
                    yield pa.RecordBatch.from_arrays([*_pairs(i[at : at + step], j), pa.array(h.ravel())], names=["i", "j", "h"])

    return here.crossJoin(there).mapInArrow(run, "i long, j long, h double")
