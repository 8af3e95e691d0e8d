"""Quality of documents by heat-kernel classification over cheap text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatloom.plans.fit import fit_logit
from heatloom.sources.points import document_points


def document_quality(spark: SparkSession, sf_dir: str, method: str = "lae", s: int = 60, k: int = 20) -> DataFrame:
    """doc_id, is_train, y_pred, pi, mean, var of every document; labelled documents of even id train."""
    points = document_points(spark, sf_dir)
    return fit_logit(points, method, s=s, r=3, k=k).predictions.withColumnRenamed("row_id", "doc_id")
