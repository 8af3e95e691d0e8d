"""Shared plumbing of the training-data operators: tables, durable intermediates, numbers of tasks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset and Spark runs in this process alone (local
    tests) a temporary folder of this machine is chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="heatloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and any executor can reread it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Opens files of the shared folder in a task."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if re.match(r"^[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}"))


_kept: list = []


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, once for all tasks of a worker with the same ``key``; one thing is kept at a time."""
    if not _kept or _kept[0] != key:
        _kept[:] = [key, make()]
    return _kept[1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``rows`` rows, so that few texts at once stand in a worker's memory as strings.

    What the worker keeps for tasks of another key than ``keep`` is let go of first, and unused buffers at the end.
    """
    if _kept and _kept[0] != keep:
        _kept.clear()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library, where it has one
        trim(0)


#: Partitions that work is dealt to at most; tasks read their rows in slices and take more of them beyond.
MOST_TASKS = 20_000


def tasks_for(spark: SparkSession, work: int, per_task: int) -> int:
    """Partitions for ``work`` units, ``per_task`` each, as many as a shuffle has at least: adaptive execution looks at bytes alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(-(-work // per_task), MOST_TASKS))


#: Rows that are sent to all tasks at most (some tens of MB); larger tables are joined by a shuffle.
SENT_ROWS = 500_000


def sent(few: DataFrame, rows: int) -> DataFrame:
    """``few``, of ``rows`` rows by count, with a broadcast hint if that many may be sent to all tasks."""
    return F.broadcast(few) if rows <= SENT_ROWS else few


def unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


#: Places in a bitmap (as Spark's bitmap functions fix it, 4 KB) and for each id that is marked.
BITMAP, PLACES = 1 << 15, 16
#: Bitmaps that are sent to all tasks at most (64 MB), and that each task puts together from its own ids.
SENT_BITMAPS, PARTIAL_BITMAPS = 1 << 14, 64


def flagged(rows: DataFrame, key: Column, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``, true wherever ``key`` is among ``ids`` (one column) and for about one in ``PLACES`` of the other keys.

    So of wide rows only few have to be shuffled to find those of certain ids. Keys are compared as longs, null among them. Ids are marked
    in bitmaps by a hash; ids that need more than ``SENT_BITMAPS`` of them flag all rows.
    """
    maps = max(1, -(-ids.count() * PLACES // BITMAP))
    if maps > SENT_BITMAPS:
        return rows.withColumn(flag, F.lit(True))
    map_no, bits = unused(rows, "__map"), unused(rows, "__bits")

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(maps * BITMAP).cast("long")) + 1

    marked = place(F.col(ids.columns[0]))
    dealt = ids.repartition(F.bitmap_bucket_number(marked)) if maps > PARTIAL_BITMAPS else ids
    marks = dealt.groupBy(F.bitmap_bucket_number(marked).alias(map_no)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(marked)).alias(bits))
    own, at = F.bitmap_bucket_number(place(key)), F.bitmap_bit_position(place(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return rows.join(F.broadcast(marks), own == F.col(map_no), "left").withColumn(flag, hit).drop(map_no, bits)
