"""Point tables: validation, features of documents, vectors, and generated shapes.

A point table has row_id bigint, x array<double>, is_train boolean and, where labelled, y (double, array<double>
or class number) and n_trials (double).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_points(points: DataFrame) -> int:
    """The dimension of ``points``; an error if there are none, or any x is null, ragged or not finite, or a row_id null."""
    return _checked(points.agg(*_checks()).first())


def _checks() -> list[Column]:
    bad = F.col("row_id").isNull() | F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return [F.count("*").alias("n"), F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("bad"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")]


def _checked(row: Row) -> int:
    if not row["n"]:
        raise ValueError("there are no points")
    if row["bad"] or row["low"] != row["high"] or row["low"] < 1:
        raise ValueError(f"{row['bad']} points are null or not finite; dimensions go from {row['low']} to {row['high']}")
    return row["low"]


def from_columns(df: DataFrame, id_col: str, features: list[str], train: str = "true", **labels: str) -> DataFrame:
    """A point table whose features are columns or SQL expressions of ``df``; labels by name (y, n_trials)."""
    x = F.array(*[F.expr(f).cast("double") for f in features])
    return df.select(F.col(id_col).cast("long").alias("row_id"), x.alias("x"), F.expr(train).alias("is_train"), *[F.expr(e).alias(k) for k, e in labels.items()])


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the embeddings table as doubles."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.lit(True).alias("is_train"), "label")


#: Cheap features of a text, as SQL, from its words and its letters alone.
WORDS, LETTERS = "split(text, '\\\\s+')", "regexp_replace(text, '[^\\\\p{L}]+', '')"
TEXT_FEATURES = (
    "log(1 + length(text))",
    "size(array_distinct(words)) / (size(words) + 1D)",
    "length(letters) / (length(text) + 1D)",
    "length(regexp_replace(letters, '[^\\\\p{Lu}]+', '')) / (length(text) + 1D)",
    "length(text) / (size(words) + 1D)",
)


def document_points(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Every document by five standardised text features; labelled documents of even id train, others don't.

    The features before standardising stay persisted; ``spark.catalog.clearCache()`` lets go of them.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"words": F.expr(WORDS), "letters": F.expr(LETTERS)})
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("double").alias("y")).dropDuplicates(["doc_id"])
    raw = docs.select("doc_id", *[F.expr(f).alias(f"f{i}") for i, f in enumerate(TEXT_FEATURES)]).join(labels, "doc_id", "left")
    points = from_columns(raw, "doc_id", [f"f{i}" for i in range(len(TEXT_FEATURES))], "y is not null and doc_id % 2 = 0", y="y")
    return standardize(points.persist())  # so that texts are read once, for the moments and for all that follows


def standardize(points: DataFrame) -> DataFrame:
    """Each coordinate centred, divided by its standard deviation (n - 1) and by the root of the dimension."""
    first = points.select(F.size("x").alias("d")).first()
    d = max(first["d"] or 0, 0) if first else 0
    stats = points.agg(*_checks(), *[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    _checked(stats)
    columns = [(F.col("x")[i] - F.lit(stats[f"m{i}"])) / F.lit((stats[f"s{i}"] or 1.0) * math.sqrt(d)) for i in range(d)]
    return points.withColumn("x", F.array(*columns))


def ring(spark: SparkSession, n: int = 4800, train: int = 100, seed: int = 1234) -> DataFrame:
    """Six circles of radius 0.5 to 1.0, labelled 1 and 0 in turn; ``train`` rows by a hash of their ids."""
    block = F.floor(F.col("id") * 6 / n)
    df = spark.range(n).withColumn("a", F.rand(seed) * 2 * math.pi).withColumn("r", 0.5 + 0.1 * block)
    points = from_columns(df, "id", ["r * cos(a)", "r * sin(a)"], "false", y=f"cast(pmod(floor(id * 6 / {n}), 2) = 0 as double)")
    return standardize(mark_train(points, train, seed))


def spiral(spark: SparkSession, n: int = 4000, train: int = 200, seed: int = 1234) -> DataFrame:
    """A spiral with a smooth signal along it; training rows carry unit noise, others the signal itself."""
    df = spark.range(n).select("id", (F.rand(seed) * 8 * math.pi).alias("a"), F.randn(seed + 1).alias("e"))
    points = from_columns(df, "id", ["pow(a + 4, 0.7) * cos(a)", "pow(a + 4, 0.7) * sin(a)"], "false", clean="3 * sin(a / 10) + 3 * cos(a / 2) + 4 * sin(4 * a / 5)", e="e")
    points = standardize(mark_train(points, train, seed))
    return points.withColumn("y", F.col("clean") + F.when(F.col("is_train"), F.col("e")).otherwise(0.0)).drop("e")


def mark_train(points: DataFrame, train: int, seed: int) -> DataFrame:
    """``points`` with ``train`` of them for training, the first by a hash of their ids."""
    chosen = points.select("row_id").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(train).select(F.col("row_id").alias("chosen"))
    joined = points.drop("is_train").join(F.broadcast(chosen), F.col("row_id") == F.col("chosen"), "left")  # as many ids as asked for
    return joined.withColumn("is_train", F.col("chosen").isNotNull()).drop("chosen")


def write_points(points: DataFrame, path: str, fmt: str = "parquet") -> None:
    points.write.format(fmt).mode("overwrite").save(path)
