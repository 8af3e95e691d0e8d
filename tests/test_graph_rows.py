"""The symmetric graph of nearest points from distances alone, against brute force."""

import numpy as np

from heatloom.operators import graph as G
from heatloom.operators.neighbors import symmetric_neighbors


def test_both_ends_find_their_edges_and_none_is_shuffled(spark, monkeypatch):
    """Equal points, equal distances and few points; the only exchange deals the points."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (40, 3)), np.repeat(rng.normal(2, 1, (1, 3)), 25, 0), np.indices((3, 3, 3)).reshape(3, -1).T]
    names = rng.permutation(1000)[: len(x)]
    ids, x = np.sort(names), x[np.argsort(names, kind="stable")]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "row_id long, x array<double>").repartition(3)
    d2 = ((x[:, None] - x) ** 2).sum(2)
    for r in (1, 7, 30, 200):
        near = np.zeros(d2.shape)
        for i, row in enumerate(d2):
            near[i, np.argsort(row, kind="stable")[:r]] = 1
        share, mean = (near + near.T) / 2, d2[near > 0].mean()
        got_ids, got_mean, rows = symmetric_neighbors(df, r)
        got, apart = np.zeros(d2.shape), np.zeros(d2.shape)
        for row in rows.collect():
            got[row["ip"], row["idx"]], apart[row["ip"], row["idx"]] = row["share"], row["d2"]
        assert (got_ids == ids).all() and np.isclose(got_mean, mean) and (got == share).all() and np.allclose(apart, np.where(share > 0, d2, 0))
    monkeypatch.setattr(G, "LOCAL_EDGES", 0)
    plan = G.graph_base(df, 0.1, True).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Aggregate" not in plan  # that of the points themselves, and their dealing
