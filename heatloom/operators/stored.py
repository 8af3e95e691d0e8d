"""Tables in the folder that all executors share: lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="heatloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
