"""Small independent computations as Spark tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def run_tasks(spark: SparkSession, f: Callable, items: list) -> list:
    """``f`` of every item, each in a task of its own; in the order of ``items``. Results must fit the driver together."""
    if len(items) <= 1:
        return [f(i) for i in items]
    sent = [spark.sparkContext.broadcast(i) for i in items]  # a task reads its own item only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(f(sent[i].value))], pa.binary())], names=["i", "out"])

    rows = spark.range(0, len(items), 1, len(items)).mapInArrow(run, "i long, out binary").collect()
    return [pickle.loads(bytes(r["out"])) for r in sorted(rows, key=lambda r: r["i"])]
