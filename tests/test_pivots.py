"""Nearest points by pivot cells against brute force."""

import numpy as np
import pytest

from heatloom.operators.pivots import nearest_by_pivots


def brute(ids, x, r):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    return {i: [(d2[a, b], ids[b]) for b in sorted(range(len(ids)), key=lambda b: (d2[a, b], ids[b]))[:r]] for a, i in enumerate(ids)}


@pytest.mark.parametrize(("dim", "r", "options"), [(2, 5, {}), (3, 1, {"pivots": 30, "residents": 9, "visitors": 7}), (12, 6, {"pivots": 5, "residents": 40})])
def test_equals_brute_force(spark, dim, r, options):
    """Clusters, a third of all points equal, and cells that are cut into blocks."""
    rng = np.random.default_rng(dim)
    x = np.r_[rng.normal(0, 1, (60, dim)), rng.normal(6, 0.3, (60, dim)), np.repeat(rng.normal(3, 1, (1, dim)), 60, 0)]
    ids = [int(i) for i in rng.permutation(180)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id long, x array<double>").repartition(3)
    near, share = nearest_by_pivots(df, r, **options)
    want = brute(ids, x, r)
    got = {row["row_id"]: [(n["d2"], n["row_id"]) for n in row["nn"]] for row in near.collect()}
    assert got.keys() == want.keys() and 0 < share <= 1
    for i, pairs in want.items():
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in pairs], atol=1e-9)
        if dim <= 8:
            assert [j for _, j in got[i]] == [j for _, j in pairs]
    if dim == 2:
        assert share < 0.6  # most cells are too far


def test_few_points_and_none(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [4.0, 6.0])], "row_id long, x array<double>")
    got = {row["row_id"]: [(n["d2"], n["row_id"]) for n in row["nn"]] for row in nearest_by_pivots(df, 9)[0].collect()}
    assert got == {7: [(0.0, 3), (0.0, 7), (25.0, 5)], 3: [(0.0, 3), (0.0, 7), (25.0, 5)], 5: [(0.0, 5), (25.0, 3), (25.0, 7)]}
    assert nearest_by_pivots(df.limit(0), 2)[0].collect() == []


def test_full_graph_takes_over_beyond_the_coordinates_of_a_task(spark, monkeypatch):
    from heatloom.operators import neighbors as N

    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (70, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    near = {row["row_id"]: [n["row_id"] for n in row["nn"]] for row in N.nearest_points(df, 4).collect()}
    monkeypatch.setattr(N, "MAX_COORDINATES", 100)
    assert {row["row_id"]: [n["row_id"] for n in row["nn"]] for row in N.nearest_points(df, 4).collect()} == near
