"""The nearest points of every point, exactly, where no task has all points: pivot cells and the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.arrow import matrix
from heatloom.functions.dense import squared_distances
from heatloom.operators.anchors import hash_sample
from heatloom.operators.stored import stored

#: Pivots, and coordinates of them, at most: they go to all tasks (16 MB).
PIVOTS, PIVOT_VALUES = 4096, 2_000_000
#: Points of a cell, and visitors of them, that a task compares at once.
RESIDENTS, VISITORS = 2048, 4096
#: Rounding of distances, as a share of the largest norm: cells this much beyond a bound are visited too.
SLACK = 1e-6

_NEAR = "array<struct<d2:double,row_id:long>>"
_NEAR_ARROW = pa.list_(pa.struct([("d2", pa.float64()), ("row_id", pa.int64())]))


@dataclass(frozen=True)
class Cells:
    """The pivots, and of each one's points the number and the largest distance from it (not below zero)."""

    u: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    slack: float

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squared_distances(x, self.u))

    def bound(self, d: np.ndarray, r: int) -> np.ndarray:
        """A distance within which at least ``r`` points lie: the cells that together have so many, at their far ends."""
        far = np.where(self.count > 0, d + self.radius, np.inf)
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(self.count[order], axis=1) >= r).argmax(1)
        return np.take_along_axis(far, order, 1)[np.arange(len(d)), enough]

    def visited(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells can have a point within ``bound``."""
        return (self.count > 0) & (d - self.radius <= bound[:, None] + self.slack)


def closest(ids: np.ndarray, x: np.ndarray, there: np.ndarray, y: np.ndarray, r: int, bound: np.ndarray) -> list[list[dict]]:
    """For each row of ``x`` its ``r`` nearest of ``y`` within ``bound``, ascending, equal distances by id."""
    order = np.argsort(there, kind="stable")
    there, y = there[order], y[order]
    d2 = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2) if x.shape[1] <= 8 else squared_distances(x, y)
    d2[ids[:, None] == there[None, :]] = 0.0
    out = []
    keep = min(r, len(there))
    for row, most in zip(d2, bound, strict=True):
        near = np.argsort(row, kind="stable")[:keep] if keep == len(there) else np.flatnonzero(row <= np.partition(row, keep - 1)[keep - 1])
        near = near[np.argsort(row[near], kind="stable")][:keep]
        near = near[row[near] <= most]
        out.append([{"d2": float(d), "row_id": int(i)} for d, i in zip(row[near], there[near], strict=True)])
    return out


def nearest_by_pivots(points: DataFrame, r: int, pivots: int | None = None, residents: int = RESIDENTS, visitors: int = VISITORS) -> tuple[DataFrame, float]:
    """row_id and nn (d2, row_id ascending) of the ``r`` nearest points of every point, itself included; and the share of pairs compared.

    Every point belongs to its nearest pivot's cell. In a first round it meets a part of its own cell, and the distance to
    its ``r``-th nearest there (or the far ends of cells that have ``r`` points) bounds the search. In the second it visits
    the cells that, by the triangle inequality, can have a point within the bound. Cells and visitors are cut
    into blocks of bounded size, so that a cell of a third of all points is many tasks. The pivots go to the tasks, points are
    shuffled to the cells they visit, and each visit brings back ``r`` candidates at most.

    Ids must be unique. Equal points are each other's neighbours at distance 0, the smaller ids first. Fewer than ``r``
    points give all of them; an empty table gives no rows.
    """
    size = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")).first()
    n, dim = size["n"], size["d"] or 1
    if not n:
        return points.sparkSession.createDataFrame([], f"row_id long, nn {_NEAR}"), 0.0
    r = min(r, n)
    pivots = min(pivots or math.ceil(math.sqrt(n)), PIVOTS, max(1, PIVOT_VALUES // dim), n)
    u = np.unique(np.array([row["x"] for row in hash_sample(points, pivots).select("x").collect()], float), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, residents):
                part = batch.slice(at, residents)
                d2 = squared_distances(matrix(part.column(1), dim), u)
                cell = d2.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d2[np.arange(len(cell)), cell]))], names=["row_id", "x", "cell", "far"])

    rows = stored(points.select("row_id", "x").mapInArrow(assign, "row_id long, x array<double>, cell int, far double"))
    count, radius = np.zeros(len(u), np.int64), np.zeros(len(u))
    for got in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each pivot
        count[got["cell"]], radius[got["cell"]] = got["n"], got["far"]
    cells = Cells(u, count, radius, SLACK * math.sqrt(size["norm"] or 0.0) + 1e-300)

    parts = np.maximum(1, -(-count // residents))

    def first(rows: pa.Table) -> pa.Table:
        ids, x = rows["row_id"].to_numpy(), matrix(rows["x"].combine_chunks(), dim)
        bound = np.empty(len(ids))
        for at in range(0, len(ids), 256):
            d = cells.distances(x[at : at + 256])
            bound[at : at + 256] = cells.bound(d, r)
            if len(ids) >= r:
                own = np.sqrt(np.partition(squared_distances(x[at : at + 256], x), r - 1, axis=1)[:, r - 1])
                bound[at : at + 256] = np.minimum(bound[at : at + 256], own)
        return pa.table({"row_id": rows["row_id"], "x": rows["x"], "cell": rows["cell"], "bound": pa.array(bound + cells.slack)})

    part_of = lambda ps, seed: F.pmod(F.xxhash64("row_id", F.lit(seed)), F.element_at(F.lit(ps.tolist()), F.col("cell") + 1)).cast("int")
    bounded = rows.withColumn("part", part_of(parts, 0)).groupBy("cell", "part").applyInArrow(first, "row_id long, x array<double>, cell int, bound double")
    bounded = stored(bounded)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(u), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                total += cells.visited(cells.distances(matrix(part.column(1), dim)), part.column(3).to_numpy()).sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    visits = np.zeros(len(u), np.int64)
    for got in bounded.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visits[got["cell"]] = got["n"]
    shifts = np.maximum(1, -(-visits // visitors))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, cell = np.nonzero(cells.visited(cells.distances(matrix(part.column(1), dim)), part.column(3).to_numpy()))
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                there = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([there.column(0), there.column(1), pa.array(cell.astype(np.int32)), there.column(3), pa.array(block.astype(np.int32))], names=["row_id", "x", "cell", "bound", "part"])

    going = bounded.select("row_id", "x", "cell", "bound").mapInArrow(visit, "row_id long, x array<double>, cell int, bound double, part int").withColumn("shift", part_of(shifts, 1))
    shift = F.explode(F.sequence(F.lit(0), F.element_at(F.lit(shifts.tolist()), F.col("cell") + 1).cast("int") - 1))
    staying = bounded.select("row_id", "x", "cell").withColumn("part", part_of(parts, 0)).select("*", shift.alias("shift"))

    def meet(home: pa.Table, away: pa.Table) -> pa.Table:
        if not home.num_rows or not away.num_rows:
            return pa.table({"row_id": pa.array([], pa.int64()), "nn": pa.array([], _NEAR_ARROW)})
        there, y = home["row_id"].to_numpy(), matrix(home["x"].combine_chunks(), dim)
        ids, x, bound = away["row_id"].to_numpy(), matrix(away["x"].combine_chunks(), dim), away["bound"].to_numpy() ** 2
        found: list = []
        for at in range(0, len(ids), 256):
            found += closest(ids[at : at + 256], x[at : at + 256], there, y, r, bound[at : at + 256] * (1 + 1e-9) + cells.slack**2)
        return pa.table({"row_id": away["row_id"].combine_chunks(), "nn": pa.array(found, _NEAR_ARROW)})

    place = ["cell", "part", "shift"]
    met = staying.groupBy(*place).cogroup(going.groupBy(*place)).applyInArrow(meet, f"row_id long, nn {_NEAR}")
    near = met.groupBy("row_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, r).alias("nn"))
    return near, float((visits * count).sum() / n**2)
