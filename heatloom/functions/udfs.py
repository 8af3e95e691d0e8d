"""Row functions as vectorised UDFs, for SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from heatloom.functions.dense import local_weights, project_simplex


def _by_shape(columns: list[pd.Series], f: Callable[..., np.ndarray]) -> pd.Series:
    """``f`` of blocks of rows whose arrays have equal lengths; null where any column is."""
    whole = ~np.logical_or.reduce([c.isna().to_numpy() for c in columns])
    out: list = [None] * len(whole)
    at: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(whole).tolist():
        at.setdefault(tuple(len(c.iat[i]) for c in columns), []).append(i)
    for rows in at.values():
        got = f(*[np.stack([np.asarray(c.iat[i], float) for i in rows]) for c in columns])
        for i, r in zip(rows, got.tolist(), strict=True):
            out[i] = r
    return pd.Series(out, dtype=object)


def register(spark: SparkSession) -> None:
    """Registers simplex_project(v), lae_weights(x, anchors) and heat_kernel(v, w, values, t)."""

    @pandas_udf("array<double>")
    def simplex_project(v: pd.Series) -> pd.Series:
        return _by_shape([v], lambda x: project_simplex(x))

    @pandas_udf("array<double>")
    def lae(x: pd.Series, anchors: pd.Series) -> pd.Series:
        flat = anchors.map(lambda us: np.concatenate([np.asarray(u, float) for u in us]), na_action="ignore")
        return _by_shape([x, flat], lambda x, u: local_weights(x, u.reshape(len(x), -1, x.shape[1])))

    @pandas_udf("double")
    def kernel(v: pd.Series, w: pd.Series, values: pd.Series, t: pd.Series) -> pd.Series:
        return _by_shape([v, w, values, t.map(lambda k: [k])], lambda a, b, e, k: (a * np.exp(-k * (1 - e)) * b).sum(1))

    spark.udf.register("simplex_project", simplex_project)
    spark.udf.register("lae_weights", lae)
    spark.udf.register("heat_kernel", kernel)
