"""Whitened embeddings: MLlib's singular values of centred rows, rescaled to the divisor n."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import written

#: A coordinate c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Coordinates from here on raise: below, sums of 2^32 rows and n times a coordinate fit 63 bits.
LARGEST = float(2**20)
#: Components whose share of the largest eigenvalue is at most this can't be told from rounding.
FLAT = 1e-11
#: Above this many dimensions the Gram matrix of a task no longer fits.
DIMENSIONS = 8192


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & (F.size(v) > 0)


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, c array<double>): the vectors without null or non-finite entries."""
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).where(_finite(F.col("c")))


def whole(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column of one length as whole numbers."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if c.size and np.abs(c).max() >= LARGEST:
        raise ValueError("coordinates must be below 2 to the power of 20")
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def column_sums(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """The most common length of the vectors (of several the longest), how many have it, and the exact sums of their whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                x = whole(lists.filter(pa.array(lengths == size)), size)
                held = seen.setdefault(size, [0, np.zeros(size, np.int64)])
                held[0] += len(x)
                held[1] += x.sum(axis=0)
        for size, (n, sums) in seen.items():
            arrays = [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=["size", "dim", "n", "s"])

    sums = rows.select("c").mapInArrow(run, "size int, dim int, n long, s long").groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = written(sums)  # a row for each length and dimension
    most = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, 0, np.zeros(0, np.int64)
    if most["size"] > DIMENSIONS:
        raise ValueError(f"at most {DIMENSIONS} dimensions")
    found = sums.where(F.col("size") == most["size"]).orderBy("dim").select("s").collect()
    return most["size"], most["n"], np.array([r["s"] for r in found], np.int64)


def centred(rows: DataFrame, size: int, n: int, sums: np.ndarray, basis: np.ndarray | None = None) -> DataFrame:
    """(vec_id, deviation, v): n*x - S squared and summed exactly, and x - S/n, projected on the columns of ``basis`` where there is one."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = n * whole(batch.column(1), size) - sums
            if np.abs(away).max() < 1 << 48:
                high, low = away >> 24, away & 0xFFFFFF
                parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
                exact = [(h << 48) + (m << 25) + o for h, m, o in zip(*(p.tolist() for p in parts), strict=True)]
            else:
                exact = (away.astype(object) ** 2).sum(axis=1)
            v = away / n
            if basis is not None:
                v = v @ basis
            deviation = pa.array([Decimal(int(e)) for e in exact], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["vec_id", "deviation", "v"])

    return rows.where(F.size("c") == size).select("vec_id", "c").mapInArrow(run, schema)


def eigenpairs(rows: DataFrame, size: int, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the covariance (divisor n) of the centred column ``v`` and unit eigenvectors as columns, at most ``count``.

    All singular values are asked for, so that MLlib decomposes the Gram matrix whole: iterations for a few of them stop
    short of double precision. Each column's largest entry is positive.
    """
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    svd = RowMatrix(vectors, n, size).computeSVD(size, computeU=False)
    values = svd.s.toArray() ** 2 / n
    basis = svd.V.toArray()[:, : len(values)]
    keep = np.flatnonzero(values > FLAT * values[0])[:count] if len(values) and values[0] > 0 else np.zeros(0, int)
    values, basis = values[keep], basis[:, keep]
    sign = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return values, basis * np.where(sign == 0, 1, sign)


def identity_error(rows: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of the ``k`` entries of ``v`` minus the identity; centred first, divisor n."""
    means = rows.select([F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(k)]).first()
    away = [F.col("v")[i] - F.lit(means[i]) for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.select([(F.sum(away[i] * away[j]) / n).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(got, cells, strict=True))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Projects every vector on the leading principal components and scales each to variance 1.

    Coordinates become whole numbers, floor(1024 c) + 100000, and their sums are exact. The rows n*x - S, over n, are
    MLlib's distributed matrix; its singular values, squared and over n, are the eigenvalues of the covariance. The total
    variance comes from the exact deviations instead, as a fraction of whole numbers. Only sums by dimension and the
    basis reach the driver; vectors are read three times and their projections are written once.

    Returns vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error: a row for each
    vector and component. Vectors that are null, empty or hold null or non-finite entries are left out, and so are those of
    another length than the most common (of equally common ones the longest). Components without variance can't be
    scaled and have no rows: equal vectors, or one alone, give none, nor does an empty table. Repeated rows and null
    or repeated ids count and come back each; other columns are ignored. Coordinates of 2^20 or more raise.
    """
    rows = clean(vectors, id_col, vector_col)
    size, n, sums = column_sums(rows)
    values, basis = eigenpairs(centred(rows, size, n, sums), size, n, components) if n else (np.zeros(0), np.zeros((0, 0)))
    k = len(values)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not k:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = written(centred(rows, size, n, sums, basis / np.sqrt(values)))
    total = Fraction(int(out.agg(F.sum("deviation")).first()[0]), n**3)
    shares = F.array(*[F.lit(float(Fraction(float(e)) / total)) for e in values])
    error = identity_error(out, k, n)
    long = out.select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
