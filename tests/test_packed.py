"""k-means over tasks reads packed rows."""

import numpy as np

from heatloom.operators import anchors as A

RNG = np.random.default_rng(5)
X = RNG.normal(size=(300, 3))


def table(spark):
    y = X[:, 0]
    rows = [(i, [float(v) for v in x], i % 2 == 0, float(t)) for i, (x, t) in enumerate(zip(X, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, is_train boolean, y double").repartition(3)


def test_kmeans_reads_packed_rows(spark, monkeypatch):
    """no step over tasks reads lists of doubles again, and a step is one job."""
    near = A.PointRows.of(table(spark))
    monkeypatch.setattr(A, "LOCAL_VALUES", 0)
    monkeypatch.setattr(A, "BLOCK_VALUES", 60)
    far = A.PointRows.of(table(spark))
    assert dict(far.blocks.dtypes) == {"ids": "binary", "x": "binary"}
    assert far.blocks.count() >= 300 // 20
    centers = X[:4]
    want = near.sums(centers)
    monkeypatch.setattr(A, "PARTIAL_VALUES", 0)
    np.testing.assert_allclose(far.sums(centers), want, rtol=1e-12)
    monkeypatch.setattr(A, "PARTIAL_VALUES", 10**6)
    monkeypatch.setattr(A, "sum_arrays", None)
    np.testing.assert_allclose(far.sums(centers), want, rtol=1e-12)
    np.testing.assert_array_equal(far.farthest(centers, 5), near.farthest(centers, 5))
    np.testing.assert_array_equal(far.part(3, 4, 1), near.part(3, 4, 1))
    np.testing.assert_array_equal(far.drawn(lambda x: np.full(len(x), 0.3), 1, 2), near.drawn(lambda x: np.full(len(x), 0.3), 1, 2))
    far.release()
