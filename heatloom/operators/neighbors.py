"""Nearest anchors of every point, and nearest points of every point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.arrow import lists, matrix
from heatloom.functions.dense import squared_distances

#: Rows whose distances are held at once.
BATCH = 2048
#: Coordinates of all points that go to the tasks at most (256 MB).
MAX_COORDINATES = 32_000_000
#: Pairs of points that a task compares in the mean.
PAIRS = 10_000_000
#: Of nearest points: the rounding of products of single precision, as a share of the largest norm; differences that are held at once; dimensions up to
#: which cells rule points out; coordinates of a block where no task has all points (8 MB).
SINGLE, PART, PIVOT_DIMENSIONS, BLOCK_VALUES = 2e-5, 100_000, 16, 1_000_000
#: Of the symmetric graph: pairs whose distances are held at once, edges of a task in the mean, and the rounding of a distance by products, as a share
#: of the largest norm.
CELLS, TASK_EDGES, ROUNDING = 4_000_000, 1_000_000, 1e-12


def nearest(x: np.ndarray, u: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances of the ``r`` nearest rows of ``u``, ascending, equal distances by number."""
    d2 = squared_distances(x, u)
    if r < len(u):
        close = d2 <= np.partition(d2, r - 1, axis=1)[:, r - 1 : r]
        if np.count_nonzero(close) == r * len(d2):
            near = np.nonzero(close)[1].reshape(-1, r)  # by row, ascending
            order = np.take_along_axis(near, np.argsort(np.take_along_axis(d2, near, 1), axis=1, kind="stable"), 1)
        else:  # equal distances at the bound
            order = np.argsort(np.where(close, d2, np.inf), axis=1, kind="stable")[:, :r]
    else:
        order = np.argsort(d2, axis=1, kind="stable")
    return order.astype(np.int32), np.take_along_axis(d2, order, axis=1)


def nearest_anchors(points: DataFrame, u: np.ndarray, r: int) -> DataFrame:
    """row_id, idx and d2: the ``r`` nearest anchors of every point; the anchors go to the tasks, the points stay."""
    if not 1 <= r <= len(u):
        raise ValueError(f"r must be between 1 and the number of anchors, {len(u)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                idx, d2 = nearest(matrix(part.column(1), u.shape[1]), u, r)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(idx), lists(d2)], names=["row_id", "idx", "d2"])

    return points.select("row_id", "x").mapInArrow(run, "row_id long, idx array<int>, d2 array<double>")


def cluster_sizes(points: DataFrame, u: np.ndarray) -> np.ndarray:
    """How many points have each anchor as their nearest; zero for anchors without any."""
    found = nearest_anchors(points, u, 1).groupBy(F.col("idx")[0].alias("a")).count().collect()
    size = np.zeros(len(u))
    for r in found:
        size[r["a"]] = r["count"]
    return size


def squared_distance(a: str, b: str):
    """The squared distance of two array columns, as a Spark expression."""
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)


def point_matrix(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All ids, ascending, and their coordinates on the driver; an error, before anything is collected, beyond ``MAX_COORDINATES``."""
    size = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if size["n"] * (size["d"] or 0) > MAX_COORDINATES:
        raise ValueError(f"{size['n']} points of {size['d']} coordinates: a full graph takes at most {MAX_COORDINATES} in all; use anchors beyond")
    rows = points.select("row_id", "x").toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    ids = rows.column(0).chunk(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(rows.column(1).chunk(0), size["d"])[order]


def closest_rows(x: np.ndarray, y: np.ndarray, r: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``y`` and squared distances of the ``r`` nearest of its rows to each row of ``x``, ascending, equal distances by place.

    Products of single precision rule out pairs that are surely farther than the ``r`` nearest so far; of the few that are left the sums of squared
    differences decide.
    """
    m, r = len(x), min(r, len(y))
    half = (y * y).sum(1) / 2
    slack = max(SINGLE, 2e-7 * x.shape[1]) * max(float((x * x).sum(1).max(initial=0.0)), 2 * float(half.max(initial=0.0)), 1e-30)
    x4, y4, half4, own = x.astype(np.float32), y.astype(np.float32), half.astype(np.float32), (x * x).sum(1) / 2
    idx, d2 = np.full((m, r), -1), np.full((m, r), np.inf)
    for lo in range(0, len(y), block):
        near = x4 @ y4[lo : lo + block].T
        np.subtract(half4[lo : lo + block], near, out=near)
        bound = d2[:, -1] / 2 - own
        if near.shape[1] >= r:  # the r-th nearest of a part of the block is a bound, too
            part = near[:, : max(8 * r, 64)] if np.isinf(bound).any() else near[:, :0]
            if part.shape[1] >= r:
                bound = np.minimum(bound, np.partition(part, r - 1, axis=1)[:, r - 1] + slack)
        at = np.flatnonzero(near <= np.minimum(bound + slack, 3e38).astype(np.float32)[:, None])
        if not len(at):
            continue
        row, col = at // near.shape[1], at % near.shape[1] + lo
        gap = np.concatenate([((x[row[i : i + PART]] - y[col[i : i + PART]]) ** 2).sum(1) for i in range(0, len(row), PART)])
        close = gap <= d2[row, -1]
        row, col, gap = row[close], col[close], gap[close]
        changed = np.unique(row)
        row = np.concatenate([np.repeat(changed, r), row])
        col, gap = np.concatenate([idx[changed].ravel(), col]), np.concatenate([d2[changed].ravel(), gap])
        order = np.lexsort((col, gap, row))
        first = np.searchsorted(row[order], changed)
        take = order[(first[:, None] + np.arange(r)).ravel()]
        idx[changed], d2[changed] = col[take].reshape(-1, r), gap[take].reshape(-1, r)
    return idx, d2


_NEAR = "row_id long, nn array<struct<d2:double,row_id:long>>"


def _listed(row_ids: pa.Array, d2: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    pairs = pa.StructArray.from_arrays([pa.array(d2.ravel()), pa.array(near.ravel())], names=["d2", "row_id"])
    starts = pa.array(np.arange(0, d2.size + 1, d2.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([row_ids, pa.ListArray.from_arrays(starts, pairs)], names=["row_id", "nn"])


def nearest_points(points: DataFrame, r: int, block: int = 4096) -> DataFrame:
    """row_id and nn (array of d2 and row_id, ascending): the ``r`` nearest points of every point, itself included.

    All points go to the tasks, in one array of checked size; each task compares its rows with ``block`` of them at a time and
    keeps the ``r`` best, equal distances by id. Points are dealt over as many tasks as their pairs ask for. The work is
    quadratic by nature: it is a full graph. Beyond ``MAX_COORDINATES`` in all no task has all points: pivot cells take over
    (``nearest_by_pivots``), or pairs of blocks where there are too many dimensions for cells to rule anything out.
    """
    size = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if size["n"] * (size["d"] or 0) > MAX_COORDINATES:
        if size["d"] > PIVOT_DIMENSIONS:
            return nearest_by_blocks(points, r, size["n"], size["d"])
        from heatloom.operators.pivots import nearest_by_pivots  # which takes its pivots from the anchors, and these their sizes from here

        return nearest_by_pivots(points, r)[0]
    ids, there = point_matrix(points)
    sent = points.sparkSession.sparkContext.broadcast((ids, there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, there = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                idx, d2 = closest_rows(matrix(part.column(1), there.shape[1]), there, r, block)
                yield _listed(part.column(0), d2, ids[idx])

    tasks = min(2000, -(-len(ids) * len(ids) // (20 * PAIRS)))
    return points.select("row_id", "x").repartition(max(tasks, 1), "row_id").mapInArrow(run, _NEAR)


def nearest_by_blocks(points: DataFrame, r: int, n: int, dim: int) -> DataFrame:
    """As ``nearest_points``, from all pairs of blocks of points: a task has two blocks, and each row gets ``r`` candidates at most from each block."""
    blocks = -(-n // max(1, BLOCK_VALUES // dim))

    def pack(x: pa.Table) -> pa.Table:
        ids = x["row_id"].to_numpy()
        order = np.argsort(ids)
        return pa.table({"ids": lists(ids[order][None, :]), "v": lists(matrix(x["x"].combine_chunks(), dim)[order].reshape(1, -1))})

    placed = points.select("row_id", "x", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).alias("block"))
    side = placed.groupBy("block").applyInArrow(pack, "ids array<long>, v array<double>").repartition(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, x, j, y = (c[row].values.to_numpy() for c in batch.columns)
                x, y = x.reshape(-1, dim), y.reshape(-1, dim)
                for at in range(0, len(i), BATCH):
                    idx, d2 = closest_rows(x[at : at + BATCH], y, r)
                    yield _listed(pa.array(i[at : at + BATCH]), d2, j[idx])

    met = side.toDF("i", "x").crossJoin(side.toDF("j", "y").hint("shuffle_replicate_nl")).mapInArrow(run, _NEAR)
    return met.groupBy("row_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, r).alias("nn"))


def symmetric_neighbors(points: DataFrame, r: int) -> tuple[np.ndarray, float, DataFrame]:
    """All ids, ascending, the mean squared distance to the ``r`` nearest points, and the symmetric graph: ip, idx, d2, share for every point.

    A point at place ip has edges to its ``r`` nearest points (itself included, equal distances by id) and to those that have it among theirs; the
    share is 1 where both hold, else 0.5. The first pass over all pairs finds how far each point reaches, the second takes the
    pairs that either end reaches. A distance is the sum of squared differences, which is the same from both ends, so that
    both find the edge by themselves and no edge is shuffled. All points go to the tasks, in one array of checked size.
    """
    ids, there = point_matrix(points)
    n, r = len(ids), min(r, len(ids))
    slack = ROUNDING * max(float((there * there).sum(1).max(initial=0.0)), 1e-288)
    sent = points.sparkSession.sparkContext.broadcast((ids, there))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of some rows, and their distances from all points but for rounding."""
        for batch in batches:
            own = np.searchsorted(sent.value[0], batch.column(0).to_numpy())
            step = max(1, CELLS // n)
            for at in range(0, len(own), step):
                yield own[at : at + step], squared_distances(sent.value[1][own[at : at + step]], sent.value[1])

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((sent.value[1][i] - sent.value[1][j]) ** 2).sum(1)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, d2 in parts(batches):
            row, col = np.nonzero(d2 <= np.partition(d2, r - 1, axis=1)[:, r - 1 : r] + 2 * slack)
            d2, cuts = exact(own[row], col), np.searchsorted(row, np.arange(len(own) + 1))
            reach, last, total = np.empty(len(own)), np.empty(len(own), np.int32), np.empty(len(own))
            for a, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                order = lo + np.argsort(d2[lo:hi], kind="stable")[:r]
                reach[a], last[a], total[a] = d2[order[-1]], col[order[-1]], d2[order].sum()
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(reach), pa.array(last), pa.array(total)], names=["ip", "reach", "last", "total"])

    tasks = min(2000, -(-n * n // (4 * PAIRS)))
    found = points.select("row_id").repartition(max(tasks, 1), "row_id").mapInArrow(reached, "ip int, reach double, last int, total double").toArrow().combine_chunks()
    place = np.argsort(found.column(0).chunk(0).to_numpy())
    reach, last, total = (found.column(c).chunk(0).to_numpy()[place] for c in (1, 2, 3))
    limits = points.sparkSession.sparkContext.broadcast((reach, last))

    def edged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, last = limits.value
        for own, d2 in parts(batches):
            row, col = np.nonzero(d2 <= np.maximum(reach[own][:, None], reach) + slack)
            i, d2 = own[row], exact(own[row], col)
            mine = (d2 < reach[i]) | ((d2 == reach[i]) & (col <= last[i]))
            its = (d2 < reach[col]) | ((d2 == reach[col]) & (i <= last[col]))
            at = np.flatnonzero(mine | its)
            starts = pa.array(np.searchsorted(row[at], np.arange(len(own) + 1)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in (col[at].astype(np.int32), d2[at], (mine[at].astype(float) + its[at]) / 2)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *columns], names=["ip", "idx", "d2", "share"])

    tasks = min(2000, -(-2 * n * r // TASK_EDGES))
    rows = points.select("row_id").repartition(max(tasks, 1), "row_id").mapInArrow(edged, "ip int, idx array<int>, d2 array<double>, share array<double>")
    return ids, float(total.sum() / (n * r)), rows
