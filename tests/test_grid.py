import numpy as np
import pytest

from heatloom.operators import grid as G
from heatloom.operators import spectrum as S
from heatloom.operators.anchors import subsample
from heatloom.operators.neighbors import nearest_anchors
from heatloom.operators.weights import mean_distance, normalize, se_weights
from heatloom.plans import fit as fits

X = np.random.default_rng(8).normal(size=(90, 3))


def points(spark, many=False):
    y = lambda i: [float(X[i, 0]), float(X[i, 1]) ** 2] if many else float(X[i, 0])
    kind = "array<double>" if many else "double"
    rows = [(i, X[i].tolist(), i % 3 > 0, y(i)) for i in range(90)]
    return spark.createDataFrame(rows, f"row_id long, x array<double>, is_train boolean, y {kind}").repartition(4).persist()


def by_id(df, c):
    return np.array([r[c] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize("gl", ["rw", "normalized", "cluster-normalized"])
@pytest.mark.parametrize("held", [4_000_000, 1])
def test_stacked_sums_equal_a_bandwidth_at_a_time(spark, monkeypatch, gl, held):
    monkeypatch.setattr(S, "LOCAL_VALUES", 0)
    monkeypatch.setattr(G, "STACKED", held)
    df, k = points(spark), 5
    anchors = subsample(df, 9, "random")
    near = nearest_anchors(df, anchors.u, 4).persist()
    scales = [a2 * mean_distance(near) for a2 in (0.3, 1.0, 4.0)]
    made = G.SeGrid(near, anchors, scales, gl, k, True)
    for a, scale in enumerate(scales):
        want, got = S.spectrum_from_weights(normalize(se_weights(near, scale), anchors, gl), 9, k, True), made.spectrum(a)
        assert np.allclose(got.values, want.values, atol=1e-9)
        v = by_id(got.vectors, "v")
        assert np.allclose(v, by_id(want.vectors, "v"), atol=1e-6)
        train, y = v[np.arange(90) % 3 > 0], X[np.arange(90) % 3 > 0, :1]
        m = got.moments(df)
        assert np.allclose(m.gram, train.T @ train) and np.allclose(m.cross, train.T @ y) and m.rows == 60 and m.square == pytest.approx((y**2).sum())


@pytest.mark.parametrize("method", ["se", "nystrom"])
@pytest.mark.parametrize("many", [False, True])
def test_jobs_of_a_fit_dont_grow_with_the_grid(spark, monkeypatch, method, many):
    """The same predictions from stacked sums as from one bandwidth at a time, by as many jobs for eight bandwidths as for two."""
    df, models = points(spark, many), fits.ModelSpec(subsample="random")
    one = lambda a2s: fits.fit_regression(df, method, s=9, r=4, k=5, a2s=a2s, models=models)
    whole = one((0.5, 2.0))
    monkeypatch.setattr(S, "LOCAL_VALUES", 0)
    monkeypatch.setattr(fits, "LOCAL_VALUES", 0)

    def jobs(a2s):
        tag = f"grid-{method}-{many}-{len(a2s)}"
        spark.sparkContext.setJobGroup(tag, tag)
        fit = one(a2s)
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)), fit

    few, fit = jobs((0.5, 2.0))
    assert np.allclose(by_id(fit.predictions, "y_pred"), by_id(whole.predictions, "y_pred"), atol=1e-4)
    assert jobs(tuple(np.linspace(0.3, 3.0, 8)))[0] == few
    monkeypatch.setattr(fits, "STACKED_VALUES", 1)
    again = one((0.5, 2.0))
    assert np.allclose(by_id(again.predictions, "y_pred"), by_id(fit.predictions, "y_pred"), atol=1e-8)


def test_missing_targets_raise(spark):
    df = points(spark)
    rows = df.selectExpr("row_id", "x", "array(y) AS ys")
    with pytest.raises(ValueError, match="no training rows"):
        G.stacked_moments(rows.limit(0), [lambda b: np.ones((b.num_rows, 1))], [1])
    with pytest.raises(ValueError, match="labels"):
        G.stacked_moments(rows.selectExpr("row_id", "x", "array(cast(null AS double)) AS ys"), [lambda b: np.ones((b.num_rows, 1))], [1])


def test_passes_hold_what_a_task_may():
    assert list(G.passes([2, 2, 2])) == [[0, 1, 2]] and list(G.passes([])) == []
