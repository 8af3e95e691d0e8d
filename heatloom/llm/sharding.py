"""Contiguous shards of equal byte size from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import written


def summed(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, part, nth and upto: of each row its partition, its place there, and the bytes up to its end there."""
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, part int, nth long, upto long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            upto = total + np.cumsum(batch.column(1).to_numpy())
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(upto)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "size", "text_crc32", "part", "nth", "upto"])
            seen, total = seen + n, int(upto[-1]) if n else total

    return rows.mapInArrow(run, schema)


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assigns every row of ``docs`` to one of ``shards`` contiguous runs of ``id_col`` of near equal bytes.

    The rows are range-partitioned by id, checksum and size and written with their prefix sums within the
    partition; each partition's bytes and rows are totalled, the totals (one row per partition) are summed up to
    global offsets, and a row belongs to the shard in which the midpoint of its bytes lies, so that each shard is
    within one row of its target. Its slot is its global place less that of the shard's first row. The text is
    read once and only its size and checksum travel.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (position in the shard, from 0).
    A null text counts as empty (size 1, checksum 0). Null ids come first. Equal ids are ordered by
    checksum and size, and can lie in several partitions; rows equal in all three are interchangeable. An empty table
    gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32")))
    order = ["doc_id", "text_crc32", "size"]
    rows = written(summed(narrow.repartitionByRange(*order).sortWithinPartitions(*order)))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select(F.col("part").alias("of"), so_far("bytes").alias("start"), so_far("n").alias("rows"), F.sum("bytes").over(Window.partitionBy()).alias("total"))

    middle = 2 * (F.col("start") + F.col("upto")) - F.col("size")
    placed = rows.join(F.broadcast(offsets), F.col("part") == F.col("of")).withColumn("middle", middle).withColumn("place", F.col("rows") + F.col("nth"))
    placed = placed.withColumn("shard", F.expr(f"int((middle * {shards}) div (2 * total))"))
    firsts = placed.groupBy(F.col("shard").alias("__shard")).agg(F.min("place").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("__shard")).select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))
