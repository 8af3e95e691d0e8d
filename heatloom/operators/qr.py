"""Triangles of tall sparse weights: singular values without squaring, by a tree of QR decompositions over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.arrow import lists, matrix

#: Rows that a task folds at most before it passes them on, and triangles that the next level takes in one task.
HELD_ROWS, FAN = 65_536, 8
#: Anchors up to which triangles are made (128 MB each); singular values below this share of the largest are noise.
QR_ANCHORS, ROUNDOFF = 4000, 1e-12


def squeeze(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many rows of each key as there are columns at most, with the same inner products: a QR of each key's rows, by halves."""
    width = rows.shape[1]
    while len(key):
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        if count.max() <= width:
            break
        place = np.arange(len(key)) - np.repeat(first, count)
        parts = -(-count // (2 * width))
        part = np.repeat(np.cumsum(parts) - parts, count) + place // (2 * width)
        blocks = np.zeros((int(parts.sum()), 2 * width, width))
        blocks[part, place % (2 * width)] = rows
        rows = np.linalg.qr(blocks, mode="r").reshape(-1, width)
        key = np.repeat(np.repeat(key[first], parts), width)
    return key, rows


def fold(triangle: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of both together, of as many rows as columns at most."""
    return np.linalg.qr(np.vstack([triangle, rows]), mode="r")


def dense(idx: np.ndarray, w: np.ndarray, s: int) -> np.ndarray:
    out = np.zeros((len(w), s))
    np.add.at(out, (np.arange(len(w))[:, None], idx), w)
    return out


def _merged(z: DataFrame) -> DataFrame:
    """Rows that weigh the same anchors, folded to as many as they have anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_idx, held_w = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(0)[0])
            idx, w = matrix(batch.column(0), width).astype(np.int32), matrix(batch.column(1), width)
            order = np.argsort(idx, axis=1, kind="stable")
            idx, w = np.take_along_axis(idx, order, 1), np.take_along_axis(w, order, 1)
            if held_idx is not None:
                idx, w = np.vstack([held_idx, idx]), np.vstack([held_w, w])
            kinds, key = np.unique(idx, axis=0, return_inverse=True)
            key, w = squeeze(key.ravel(), w)
            held_idx, held_w = kinds[key], w
            if len(w) > HELD_ROWS:
                yield from _blocks(held_idx, held_w)
                held_idx = None
        if held_idx is not None:
            yield from _blocks(held_idx, held_w)

    return z.mapInArrow(run, "idx array<int>, w array<double>")


def _blocks(idx: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(w), 8192):
        yield pa.RecordBatch.from_arrays([lists(idx[at : at + 8192]), lists(w[at : at + 8192])], names=["idx", "w"])


def _numbered(triangle: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a triangle by number: where a row goes next depends on the number alone, so a repeated task deals alike."""
    step = max(1, 2_000_000 // triangle.shape[1])
    for at in range(0, len(triangle), step):
        part = triangle[at : at + step]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int64()), lists(part)], names=["j", "row"])


def triangle(z: DataFrame, scale: np.ndarray) -> np.ndarray:
    """R of Z diag(scale) = QR on the driver, anchors by anchors, whatever the number of points.

    Tasks fold rows of the same anchors first, so what is shuffled follows the number of sets of anchors that occur; then
    each task makes a dense triangle, and triangles are folded a few at a time. An empty Z gives zeros.
    """
    s = len(scale)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column(0)[0])
                idx, w = matrix(batch.column(0), width).astype(np.int32), matrix(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([lists(idx), lists(w * scale[idx])], names=["idx", "w"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((0, s))
        for batch in batches:
            for at in range(0, batch.num_rows, max(s, 256)):
                part = batch.slice(at, max(s, 256))
                width = len(part.column(0)[0])
                out = fold(out, dense(matrix(part.column(0), width).astype(int), matrix(part.column(1), width), s))
        yield from _numbered(out)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((0, s))
        for batch in batches:
            for at in range(0, batch.num_rows, max(s, 256)):
                out = fold(out, matrix(batch.column(1).slice(at, max(s, 256)), s))
        yield from _numbered(out)

    spark = z.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = _merged(_merged(z.select("idx", "w").mapInArrow(scaled, "idx array<int>, w array<double>")).repartition(tasks, "idx"))
    found = rows.mapInArrow(first, "j long, row array<double>")
    while tasks > 1:
        tasks = -(-tasks // FAN)
        found = found.repartition(tasks, F.col("j")).mapInArrow(again, "j long, row array<double>")
    got = found.orderBy("j").toArrow()
    return matrix(got.column("row").combine_chunks(), s) if got.num_rows else np.zeros((1, s))


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values over rounding errors and right singular vectors of a triangle, the largest entry of each vector positive."""
    _, sigma, vt = np.linalg.svd(r, full_matrices=False)
    keep = sigma[:k] > ROUNDOFF * max(float(sigma[0]), np.finfo(float).tiny)
    right = vt[:k][keep].T
    return sigma[:k][keep], right * np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1.0, 1.0)
