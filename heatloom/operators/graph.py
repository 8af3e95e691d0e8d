"""The full graph of all points: nearest-neighbour edges, its normalised walk, and its leading eigenvectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.dense import TINY, squared_distances
from heatloom.functions.arrow import lists
from heatloom.operators.multilevel import leading_pairs
from heatloom.operators.neighbors import MAX_COORDINATES, nearest_points, point_matrix, symmetric_neighbors
from heatloom.operators.nystrom import graph_spectrum
from heatloom.operators.spectrum import Spectrum

#: Points up to which all pairs are taken, and points of a full graph at most: its blocks of vectors are held on the driver.
WHOLE, BLOCK = 3000, 300_000
#: Edges up to which products are computed on the driver (200 MB): jobs would cost more than the arithmetic.
LOCAL_EDGES = 10_000_000
#: Entries of a row in the mean from which rows are multiplied one by one, and edges of a packed block (3 MB).
LONG_ROWS, PACKED_EDGES = 16, 250_000


def neighbor_count(n: int, threshold: float) -> int:
    """The share ``threshold`` of ``n`` points, half away from zero, three at least."""
    return min(n, max(math.floor(threshold * n + 0.5), 3))


def edges(near: DataFrame) -> DataFrame:
    """(i, j, d2) of nearest-point lists."""
    return near.select(F.col("row_id").alias("i"), F.explode("nn").alias("e")).select("i", F.col("e.row_id").alias("j"), F.col("e.d2").alias("d2"))


def walk(pairs: DataFrame, scale: float) -> DataFrame:
    """(i, j, w, root): the symmetric normalised walk of edges (i, j, d2), and the root of each i's corrected degree.

    Similarities exp(-d2 / scale) are averaged with their transpose, divided by both ends' degrees, and by the roots of
    both ends' new degrees.
    """
    z = pairs.select("i", "j", F.exp(-F.col("d2") / F.lit(float(scale))).alias("w"))
    sym = z.union(z.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))

    def degrees(e: DataFrame, end: str, name: str) -> DataFrame:
        return e.groupBy("i").agg((F.sum("w") + TINY).alias(name)).withColumnRenamed("i", end)

    a = sym.join(degrees(sym, "i", "di"), "i").join(degrees(sym, "j", "dj"), "j").select("i", "j", (F.col("w") / F.col("di") / F.col("dj")).alias("w"))
    both = a.join(degrees(a, "i", "di"), "i").join(degrees(a, "j", "dj"), "j")
    return both.select("i", "j", (F.col("w") / F.sqrt("di") / F.sqrt("dj")).alias("w"), F.sqrt("di").alias("root"))


@dataclass(frozen=True)
class SparseRows:
    """A symmetric sparse matrix by rows, none of them empty: on the driver (starts, columns, values) or as a table (ip, idx, w), also of packed blocks."""

    n: int
    local: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    table: DataFrame | None = None

    def _tasks(self, schema: str, f: Callable, sent: object = None) -> DataFrame:
        """Columns from the places, starts, columns and values of each packed block of the table's rows, and from ``sent``."""
        table = self.table if "starts" in self.table.columns else packed(self.table, ["w"])
        return blocks_to(table, schema, f, sent)

    def _column(self, kind: str, f: Callable, fill: np.ndarray) -> np.ndarray:
        """``fill``, one number for each row, with what tasks find."""
        return spread(self._tasks(PLACED, lambda *block: binaries(block[0], f(*block).astype(kind))), kind, fill)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The product with ``block``, which has a row for each point."""
        if self.local:
            return _product(*self.local, block)
        sent = self.table.sparkSession.sparkContext.broadcast(block)
        out = spread(self._tasks(PLACED, lambda ip, s, c, w, b: binaries(ip, _product(s, c, w, b)), sent), "f8", np.zeros(block.shape))
        sent.destroy()  # one for each of many products, each kept on disk
        return out

    def diagonal(self) -> np.ndarray:
        if self.local:
            return _diagonal(np.arange(self.n), *self.local)
        return self._column("f8", lambda ip, s, c, w, _: _diagonal(ip, s, c, w), np.zeros(self.n))

    def strongest(self, least: float) -> np.ndarray:
        """Of each row the column of its largest entry beside the diagonal; the row itself where none is above ``least``."""
        if self.local:
            return _strongest(np.arange(self.n), *self.local, least)
        return self._column("i4", lambda ip, s, c, w, _: _strongest(ip, s, c, w, least), np.arange(self.n))

    def contracted(self, label: np.ndarray, share: np.ndarray, m: int) -> SparseRows:
        """P'WP for the matrix P of ``m`` columns that has ``share`` of each row in the column ``label``; by sums of tasks for a table."""

        def sums(ip: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            owner = np.repeat(ip, np.diff(starts))
            key = label[owner].astype(np.int64) * m + label[columns]
            order = np.argsort(key, kind="stable")
            key, w = key[order], (values * share[owner] * share[columns])[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[new], np.add.reduceat(w, new)

        if self.local:
            key, w = sums(np.arange(self.n), *self.local)
            return SparseRows(m, (np.searchsorted(key // m, np.arange(m + 1)), key % m, w))
        table = self._tasks("key long, w double", lambda ip, s, c, w, _: [pa.array(x) for x in sums(ip, s, c, w)]).groupBy("key").agg(F.sum("w").alias("w")).persist()
        if table.count() <= LOCAL_EDGES:
            got = table.orderBy("key").toArrow().combine_chunks()
            table.unpersist()
            key, w = got.column(0).chunk(0).to_numpy(), got.column(1).chunk(0).to_numpy()
            return SparseRows(m, (np.searchsorted(key // m, np.arange(m + 1)), key % m, w))
        entry = F.array_sort(F.collect_list(F.struct(F.pmod("key", F.lit(m)).cast("int").alias("idx"), "w")))
        rows = table.groupBy(F.expr(f"cast(key div {m} as int)").alias("ip")).agg(entry.alias("e")).select("ip", F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
        return SparseRows(m, table=packed(rows, ["w"]).persist())


#: What tasks give of some rows: their places and one or more numbers of each, as bytes.
PLACED = "ip binary, v binary"


def binaries(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]


def spread(rows: DataFrame, kind: str, fill: np.ndarray) -> np.ndarray:
    """``fill`` with the numbers of ``rows`` (as ``PLACED``) at their places."""
    got = rows.toArrow()
    for ip, v in zip(got.column(0), got.column(1), strict=True):
        fill[np.frombuffer(ip.as_buffer(), "i4")] = np.frombuffer(v.as_buffer(), kind).reshape(-1, *fill.shape[1:])
    return fill


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """ip, starts, idx and ``names``, as bytes, of blocks of the rows (ip, idx, ...): arrays of numbers would be read one by one for every product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ip, ends = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
            at = 0
            while at < len(ip):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PACKED_EDGES, "right")) - 1)
                flat = [batch.column(c).slice(at, to - at).flatten().to_numpy() for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(binaries(ip[at:to].astype("i4"), (ends[at : to + 1] - ends[at]).astype("i4"), flat[0].astype("i4"), *flat[1:]), names=["ip", "starts", "idx", *names])
                at = to

    return rows.select("ip", "idx", *names).mapInArrow(run, "ip binary, starts binary, idx binary, " + ", ".join(f"{c} binary" for c in names))


def blocks_to(table: DataFrame, schema: str, f: Callable, sent: object = None) -> DataFrame:
    """Columns by ``f`` from places, starts, columns and further numbers of each packed block, and from what ``sent`` broadcasts."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = [np.frombuffer(c[row].as_buffer(), "i4" if i < 3 else "f8") for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(f(*block, sent and sent.value), names=names)

    return table.mapInArrow(run, schema)


def _product(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, block: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts) - 1, block.shape[1]))
    if len(columns) >= LONG_ROWS * len(out):  # row by row, what is taken of the block stays in the cache
        cuts = starts.tolist()
        for a, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            np.dot(values[lo:hi], block.take(columns[lo:hi], axis=0), out=out[a])
        return out
    step = max(1, 4000 * len(out) // max(1, len(columns)))
    for at in range(0, len(out), step):
        cut = starts[at : at + step + 1]
        taken = np.take(block, columns[cut[0] : cut[-1]], axis=0)
        taken *= values[cut[0] : cut[-1], None]
        np.add.reduceat(taken, cut[:-1] - cut[0], axis=0, out=out[at : at + step])
    return out


def _diagonal(ip: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(ip)), np.diff(starts))
    own = columns == ip[owner]
    return np.bincount(owner[own], values[own], len(ip))


def _strongest(ip: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, least: float) -> np.ndarray:
    owner = np.repeat(np.arange(len(ip)), np.diff(starts))
    w = np.where(columns == ip[owner], -1.0, values)
    at = np.flatnonzero((w == np.maximum.reduceat(w, starts[:-1])[owner]) & (w > least))
    rows, first = np.unique(owner[at], return_index=True)
    out = np.array(ip)
    out[rows] = columns[at[first]]
    return out


def subspace(w: DataFrame, ids: np.ndarray, k: int, **options) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenpairs of the sparse symmetric matrix (i, j, w) with eigenvalues in [-1, 1]; rows of vectors follow ``ids``."""
    rows = packed(by_rows(w, ids, ["w"]), ["w"]).persist()
    try:
        return leading_pairs(SparseRows(len(ids), table=rows), k, **options)
    finally:
        rows.unpersist()


def by_rows(entries: DataFrame, ids: np.ndarray, names: list[str]) -> DataFrame:
    """ip, idx and ``names`` (arrays) from (i, j, ...): the entries of each row, by the places of ``ids`` (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [pa.array(np.searchsorted(ids, batch.column(c).to_numpy()).astype(np.int32)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*places, *batch.columns[2:]], names=["ip", "jp", *names])

    placed = entries.select("i", "j", *names).mapInArrow(run, "ip int, jp int, " + ", ".join(f"{c} double" for c in names))
    packed = placed.groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("jp", *names))).alias("e"))
    return packed.select("ip", F.col("e.jp").alias("idx"), *[F.col(f"e.{c}").alias(c) for c in names])


@dataclass
class Graph:
    """What all bandwidths share: ids, the mean squared distance, and d2 and share of each symmetric edge; or all pairs, whole."""

    ids: np.ndarray
    mean: float
    rows: DataFrame | None = None  # packed
    local: tuple[np.ndarray, ...] | None = None  # starts, columns, d2, share
    whole: np.ndarray | None = None  # squared distances of all pairs
    start: np.ndarray | None = None  # the eigenvectors of the bandwidth before

    def scaled(self, scale: float) -> tuple[SparseRows, np.ndarray]:
        """The normalised walk for one bandwidth, and the root of each row's corrected degree.

        Similarities exp(-d2 / scale), averaged with their transpose, are divided by both ends' degrees, and by the roots of
        both ends' new degrees; ``walk`` gives the same as a table.
        """
        n, one = len(self.ids), np.ones((len(self.ids), 1))
        if self.local:
            starts, columns, d2, share = self.local
            owner = np.repeat(np.arange(n), np.diff(starts))
            w = share * np.exp(-d2 / scale)
            for power in (1.0, 0.5):
                degree = SparseRows(n, (starts, columns, w)).times(one)[:, 0] + TINY
                w = w / degree[owner] ** power / degree[columns] ** power
            return SparseRows(n, (starts, columns, w)), np.sqrt(degree)
        degree = degrees(self.rows, scale, one[:, 0]) + TINY
        again = degrees(self.rows, scale, degree) + TINY
        return SparseRows(n, table=weighed(self.rows, scale, degree * np.sqrt(again))), np.sqrt(again)


def _similarities(rows: DataFrame, scale: float, by: np.ndarray, schema: str, f: Callable) -> tuple[DataFrame, Broadcast]:
    """Columns by ``f`` from places, starts, columns and the values share * exp(-d2 / scale), divided by ``by`` of their row and of their column, of each packed block."""
    sent = rows.sparkSession.sparkContext.broadcast(by)

    def run(ip: np.ndarray, starts: np.ndarray, idx: np.ndarray, d2: np.ndarray, share: np.ndarray, by: np.ndarray) -> list[pa.Array]:
        return f(ip, starts, idx, share * np.exp(d2 / -scale) / np.repeat(by[ip], np.diff(starts)) / by[idx])

    return blocks_to(rows, schema, run, sent), sent


def degrees(rows: DataFrame, scale: float, by: np.ndarray) -> np.ndarray:
    """The sum of each row's similarities divided by ``by``."""
    got, sent = _similarities(rows, scale, by, PLACED, lambda ip, starts, _, w: binaries(ip, np.add.reduceat(w, starts[:-1])))
    out = spread(got, "f8", np.zeros(len(by)))
    sent.destroy()
    return out


def weighed(rows: DataFrame, scale: float, by: np.ndarray) -> DataFrame:
    """Packed blocks of the similarities divided by ``by``."""
    return _similarities(rows, scale, by, "ip binary, starts binary, idx binary, w binary", binaries)[0]


def graph_eigen(points: DataFrame, graph: Graph, a2: float, k: int) -> Spectrum:
    """The walk's spectrum for one bandwidth."""
    n = len(graph.ids)
    if graph.whole is not None:
        values, vectors, _ = graph_spectrum(np.exp(-graph.whole / (a2 * graph.mean)), min(k, n))
    else:
        walked, root = graph.scaled(a2 * graph.mean)
        if walked.table is not None:
            walked = SparseRows(n, table=walked.table.persist())
        try:
            values, vectors = leading_pairs(walked, min(k, n), root, graph.start)
        finally:
            if walked.table is not None:
                walked.table.unpersist()
        graph.start = vectors
        vectors = vectors / root[:, None]
        vectors = vectors * (np.sqrt(n) / np.sqrt((vectors**2).sum(0)))
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    table = pa.table({"row_id": pa.array(graph.ids, pa.int64()), "v": lists(vectors)})
    return Spectrum(values, points.sparkSession.createDataFrame(table), (graph.ids, vectors))


def graph_base(points: DataFrame, threshold: float, sparse: bool) -> Graph:
    """The edges of all bandwidths; an error, before any work, for more points than a full graph takes."""
    n = points.count()
    if n > BLOCK:
        raise ValueError(f"{n} points: a full graph has at most {BLOCK}; use anchors beyond")
    if not sparse:
        if n > WHOLE:
            raise ValueError(f"all pairs of over {WHOLE} points; use a sparse graph")
        ids, x = point_matrix(points)
        d2 = squared_distances(x, x)
        return Graph(ids, float(d2.mean()), whole=d2)
    r = neighbor_count(n, threshold)
    dim = points.agg(F.max(F.size("x"))).first()[0] or 0
    ids, mean, rows = symmetric_neighbors(points, r) if n * dim <= MAX_COORDINATES else _by_edges(points, r)
    if 2 * n * r > LOCAL_EDGES:
        rows = packed(rows, ["d2", "share"]).persist()
        rows.count()
        return Graph(ids, mean, rows)
    rows = rows.persist()
    got = rows.orderBy("ip").toArrow().combine_chunks()
    rows.unpersist()
    columns = [got.column(c).chunk(0) for c in ("idx", "d2", "share")]
    return Graph(ids, mean, local=(columns[0].offsets.to_numpy().astype(np.int64), *[c.flatten().to_numpy() for c in columns]))


def _by_edges(points: DataFrame, r: int) -> tuple[np.ndarray, float, DataFrame]:
    """As ``symmetric_neighbors``, for points of too many coordinates for a task: edges meet their transpose in a shuffle."""
    pairs = edges(nearest_points(points, r))
    mean = pairs.agg(F.avg("d2")).first()[0]
    ids = np.sort(points.select("row_id").toArrow().column(0).to_numpy())
    both = pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d2"))
    both = both.groupBy("i", "j").agg(F.max("d2").alias("d2"), (F.count("*") / 2).alias("share"))
    return ids, mean, by_rows(both, ids, ["d2", "share"])
