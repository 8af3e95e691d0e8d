"""Anchor points: k-means centers, random rows, or mini-batch k-means."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions.arrow import lists, matrix, sum_arrays
from heatloom.functions.dense import squared_distances
from heatloom.operators.neighbors import cluster_sizes

#: Coordinates up to which k-means runs on the driver: jobs would cost more than the arithmetic.
LOCAL_VALUES = 2_000_000
#: Beyond, coordinates of a packed block (1 MB), and values of all tasks' sums that the driver adds up by itself (16 MB).
BLOCK_VALUES, PARTIAL_VALUES = 131_072, 2_000_000
#: Steps of k-means at most; batches of the mini-batch form, and their rows per anchor.
KMEANS_STEPS, BATCHES, BATCHED = 100, 30, 10
#: Rounds of oversampling before k-means, and the number of the first, beside those of batches, that draws depend on.
SEED_ROUNDS, SEED_STEP = 5, 1000
#: Anchors at most: matrices of anchors by anchors are held on the driver and in every task.
MAX_ANCHORS = 8000


@dataclass(frozen=True)
class Anchors:
    u: np.ndarray
    size: np.ndarray  # rows for which an anchor is the nearest

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(v) for v in u], int(n)) for i, (u, n) in enumerate(zip(self.u, self.size, strict=True))]
        return spark.createDataFrame(rows, "anchor_id int, u array<double>, cluster_size bigint")


def hash_sample(points: DataFrame, s: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """``s`` rows without replacement, the first by a hash of their ids (or by ``key``): the same whatever the partitions."""
    by = F.expr(key) if key else F.xxhash64("row_id", F.lit(seed))
    return points.orderBy(by, "row_id").limit(s)


def spread_out(x: np.ndarray, s: int, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
    """``s`` rows of ``x``, each drawn by its squared distance to those before, times its ``weight``."""
    rng = np.random.default_rng(seed)
    weight = np.ones(len(x)) if weight is None else weight
    first = x[min(np.searchsorted(np.cumsum(weight), rng.uniform() * weight.sum(), "right"), len(x) - 1)]
    centers = np.empty((s, x.shape[1]))
    centers[0] = first
    nearest = ((x - first) ** 2).sum(1)
    for i in range(1, s):
        share = np.cumsum(nearest * weight)
        pick = x[min(np.searchsorted(share, rng.uniform() * share[-1]), len(x) - 1)] if share[-1] > 0 else x[rng.integers(len(x))]
        centers[i] = pick
        nearest = np.minimum(nearest, ((x - pick) ** 2).sum(1))
    return centers


def assigned(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([squared_distances(x[i : i + 4096], centers).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def cluster_sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of each center's rows the sums of coordinates and the count, and last the cost; flat, so that parts add up."""
    own, s = assigned(x, centers), len(centers)
    sums = np.stack([np.bincount(own, weights=c, minlength=s) for c in np.ascontiguousarray(x.T)], 1)
    gap = (x - centers[own]).ravel()
    return np.r_[sums.ravel(), np.bincount(own, minlength=s), gap @ gap]


@dataclass
class PointRows:
    """All points: on the driver, in order of ids, where they are few, else where they lie, in packed blocks. Both give the same sums."""

    points: DataFrame
    n: int
    d: int
    local: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, points: DataFrame) -> PointRows:
        rows = points.select("row_id", "x")
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
        out = cls(rows, size["n"], size["d"] or 0)
        if out.n * out.d <= LOCAL_VALUES:
            out.local = _matrix_of(rows, out.d)
        return out

    @cached_property
    def blocks(self) -> DataFrame:
        """ids and coordinates of blocks of rows as bytes, kept by the tasks: each step reads all rows, and lists are dear to read."""
        d, most = self.d, max(1, BLOCK_VALUES // self.d)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, most):
                    part = batch.slice(at, most)
                    ids, x = part.column(0).to_numpy().astype(np.int64), matrix(part.column(1), d)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

        return self.points.mapInArrow(run, "ids binary, x binary").persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def tasks(self) -> int:
        return self.blocks.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]

    def release(self) -> None:
        if "blocks" in self.__dict__:
            self.blocks.unpersist()

    def _each(self, f: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """What ``f`` gives for ids and coordinates of each block."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x in zip(*batch.columns, strict=True):
                    yield f(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(x.as_buffer()).reshape(-1, d))

        return self.blocks.mapInArrow(run, schema)

    def _chosen(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The rows for which ``f`` of ids and coordinates is true, in order of ids."""

        def take(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            at = f(ids, x)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), lists(x[at])], names=["row_id", "x"])

        return _matrix_of(self._each(take, "row_id long, x array<double>"), self.d)[1]

    def sums(self, centers: np.ndarray) -> np.ndarray:
        if self.local:
            return cluster_sums(self.local[1], centers)
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(centers.size + len(centers) + 1)
            for batch in batches:
                for x in batch.column(0):
                    total += cluster_sums(np.frombuffer(x.as_buffer()).reshape(-1, d), centers)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["a"])

        parts = self.blocks.select("x").mapInArrow(run, "a array<double>")
        if self.tasks * (centers.size + len(centers)) > PARTIAL_VALUES:
            return sum_arrays(parts)
        return np.sum([np.asarray(a.values) for a in parts.toArrow().column(0)], axis=0)  # small enough that a second level of tasks costs more

    def farthest(self, centers: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` rows that are farthest from their centers, the first by id of equals."""
        if self.local:
            x = self.local[1]
            return x[np.argsort(-((x - centers[assigned(x, centers)]) ** 2).sum(1), kind="stable")[:count]]

        def far(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), lists(x), pa.array(((x - centers[assigned(x, centers)]) ** 2).sum(1))], names=["row_id", "x", "d2"])

        rows = self._each(far, "row_id long, x array<double>, d2 double").orderBy(F.desc("d2"), "row_id").limit(count)
        return np.array([r["x"] for r in rows.collect()])

    def part(self, step: int, parts: int, seed: int) -> np.ndarray:
        """About one in ``parts`` rows, in order of ids, other ones in each step; by a hash of their ids."""
        if self.local:
            return self.local[1][_mixed(self.local[0], seed, step) % np.uint64(parts) == 0]
        return self._chosen(lambda ids, _: _mixed(ids, seed, step) % np.uint64(parts) == 0)

    def distinct(self, most: int) -> np.ndarray | None:
        """The distinct rows, if there are ``most`` at most."""
        if self.local:
            found = np.unique(self.local[1], axis=0)
        else:
            found = np.array(sorted(r["x"] for r in self.points.select("x").distinct().limit(most + 1).collect()))
        return found if len(found) <= most else None

    def drawn(self, chance: Callable[[np.ndarray], np.ndarray], seed: int, step: int) -> np.ndarray:
        """Rows, in order of ids, whose number between 0 and 1 (by a hash of id, seed and step) is below their ``chance``."""
        if self.local:
            ids, x = self.local
            return x[_uniform(ids, seed, step) < chance(x)]
        return self._chosen(lambda ids, x: _uniform(ids, seed, step) < chance(x))


def _uniform(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    return (_mixed(ids, seed, step) >> np.uint64(11)).astype(float) / (1 << 53)


def seeding(rows: PointRows, s: int, seed: int) -> np.ndarray:
    """``s`` starting centers from all rows, by oversampling in rounds (k-means||).

    In each of ``SEED_ROUNDS`` rounds every row becomes a candidate with a chance of ``s`` times its share of the cost, on its
    own; about ``SEED_ROUNDS`` times ``s`` candidates, weighed by the rows nearest to them, are thinned out to ``s``
    on the driver. Draws follow from ids, so that few rows on the driver and many in tasks give the same.
    """
    found, share = np.zeros((0, rows.d)), 16 / max(rows.n, 1)
    while not len(found):
        found = rows.drawn(lambda x: np.full(len(x), share), seed, SEED_STEP)[:1]
        share *= 8
    for turn in range(1, 4 * SEED_ROUNDS):
        cost = float(rows.sums(found)[-1])
        if cost <= 0 or turn > SEED_ROUNDS and len(found) >= s:
            break
        known = found
        new = rows.drawn(lambda x: np.minimum(1.0, s / cost * ((x - known[assigned(x, known)]) ** 2).sum(1)), seed, SEED_STEP + turn)  # noqa: B023
        found = np.unique(np.concatenate([found, new]), axis=0)
    if len(found) < s:
        found = np.concatenate([found, rows.farthest(found, s - len(found))])
    if len(found) <= s:
        return found
    return spread_out(found, s, seed, rows.sums(found)[found.size : -1])


def _matrix_of(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("row_id", "x").toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, d))
    ids = got.column(0).chunk(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(got.column(1).chunk(0), d)[order]


def _mixed(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + step) % (1 << 64))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return x ^ (x >> np.uint64(31))


def lloyd(rows: PointRows, s: int, steps: int, seed: int) -> tuple[np.ndarray, float]:
    """Centers and cost of k-means over all rows from a spread-out seeding; empty clusters take the farthest rows."""
    centers = seeding(rows, s, seed)
    for _ in range(steps):
        total = rows.sums(centers)
        sums, size = total[: centers.size].reshape(centers.shape), total[centers.size : -1]
        new = sums / np.maximum(size, 1)[:, None]
        empty = np.flatnonzero(size == 0)
        if len(empty):
            far = rows.farthest(centers, len(empty))
            new[empty[: len(far)]] = far
        if np.allclose(new, centers, rtol=0, atol=1e-9):
            break
        centers = new
    return centers, float(rows.sums(centers)[-1])


def mini_batches(rows: PointRows, s: int, steps: int, seed: int) -> np.ndarray:
    """Centers that move towards the means of fresh batches of about ``BATCHED`` rows per center, by their share of all rows seen."""
    parts = max(1, rows.n // (BATCHED * s))
    centers = seeding(rows, s, seed)
    seen = np.zeros(len(centers))
    for step in range(steps):
        x = rows.part(step, parts, seed)
        if len(x):
            total = cluster_sums(x, centers)
            sums, size = total[: centers.size].reshape(centers.shape), total[centers.size : -1]
            seen += size
            centers = centers + np.where(size[:, None] > 0, sums - size[:, None] * centers, 0.0) / np.maximum(seen, 1)[:, None]
    return centers


def subsample(points: DataFrame, s: int, method: str = "kmeans", nstart: int = 1, seed: int = 0) -> Anchors:
    """``s`` anchors of ``points`` (fewer if there are fewer distinct rows) with the sizes of their clusters.

    "kmeans" runs Lloyd's algorithm over all rows and keeps the best of ``nstart`` runs; "random" takes rows;
    "minibatchkmeans" moves centers by successive batches that are drawn anew from all rows. Small tables are
    read once and iterated on the driver by the same steps.
    """
    if not 1 <= s <= MAX_ANCHORS:
        raise ValueError(f"the number of anchors must be between 1 and {MAX_ANCHORS}")
    if method == "random":
        u = np.array([r["x"] for r in hash_sample(points, s, seed).select("x").collect()])
    elif method in ("kmeans", "minibatchkmeans"):
        rows = PointRows.of(points)
        if (u := rows.distinct(s)) is None:
            if method == "kmeans":
                u = min((lloyd(rows, s, KMEANS_STEPS, seed + i) for i in range(nstart)), key=lambda c: c[1])[0]
            else:
                u = mini_batches(rows, s, BATCHES, seed)
        rows.release()
    else:
        raise ValueError(f"unknown subsample method {method!r}")
    return Anchors(u, cluster_sizes(points, u))
