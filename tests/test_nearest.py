"""Nearest points by products of single precision and exact differences, whole and by pairs of blocks."""

import numpy as np

from heatloom.operators import neighbors as N


def test_close_and_equal_points_far_from_the_origin(spark, monkeypatch):
    """Distances below the rounding of products, many equal points, fewer points than asked for; the same by pairs of blocks."""
    rng = np.random.default_rng(2)
    x = 100 + np.r_[rng.normal(0, 1, (150, 20)), rng.normal(3, 1e-7, (60, 20)), np.repeat(rng.normal(3, 1, (1, 20)), 90, 0)]
    x = x[rng.permutation(300)]
    d2 = ((x[:, None] - x) ** 2).sum(2)
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").repartition(3)
    for r in (1, 5, 120, 400):
        order = np.argsort(d2, axis=1, kind="stable")[:, :r]
        want = {7 * i: list(zip(d2[i, row].tolist(), (7 * row).tolist(), strict=True)) for i, row in enumerate(order)}
        idx, gap = N.closest_rows(x, x, r, 64)
        assert (idx == order).all() and (gap == np.take_along_axis(d2, order, 1)).all()
        if r == 5:
            listed = lambda near: {row["row_id"]: [(n["d2"], n["row_id"]) for n in row["nn"]] for row in near.collect()}
            assert listed(N.nearest_points(df, r)) == want
            monkeypatch.setattr(N, "MAX_COORDINATES", 100)
            monkeypatch.setattr(N, "BLOCK_VALUES", 1500)
            assert listed(N.nearest_points(df, r)) == want
