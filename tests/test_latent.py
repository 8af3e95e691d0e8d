"""Classification in tasks against the same on the driver."""

import numpy as np
import pytest

from heatloom.functions import gp, polyagamma
from heatloom.functions.dense import minimize_log, minimize_log_many
from heatloom.operators.latent import Search, TrainingRows
from heatloom.plans import fit as fits

RNG = np.random.default_rng(0)
M, K = 120, 5
V = np.linalg.qr(RNG.standard_normal((M, K)))[0] * np.sqrt(M)
VALUES, TRIALS = np.linspace(1, 0.6, K), RNG.integers(1, 4, M).astype(float)
Y = RNG.binomial(TRIALS.astype(int), gp.sigmoid(V @ RNG.standard_normal(K))).astype(float)


@pytest.fixture(scope="module")
def tables(spark):
    points = spark.createDataFrame([(i, True, float(Y[i]), float(TRIALS[i])) for i in range(M)], "row_id long, is_train boolean, y double, n_trials double")
    vectors = spark.createDataFrame([(i, V[i].tolist()) for i in range(M)], "row_id long, v array<double>")
    return points, vectors


def test_newton_by_sums_finds_the_modes_of_the_driver(tables):
    points, vectors = tables
    rows = TrainingRows(points, vectors.repartition(3), K)
    searches = [Search(gp.heat(VALUES, t), ridge) for t, ridge in ((3.0, 1e-3), (0.2, 0.5), (30.0, 0.0))]
    for search, (evidence, done, at) in zip(searches, rows.modes(searches), strict=True):
        want = gp.laplace_mode(V, search.lam, search.ridge, Y, TRIALS)
        assert evidence == pytest.approx(want.evidence, abs=1e-8) and len(done.steps) < 12
        assert np.allclose(at.gradient, V.T @ want.gradient, atol=1e-8)
        assert np.allclose(at.second, V.T @ (V * (want.weight / (1 + search.ridge * want.weight))[:, None]), atol=1e-8)
    rows.release()


def test_polya_gamma_sweeps_by_sums(tables):
    """The same draws however rows are dealt and however often variables are stored; the moments of the driver's sampler."""
    from heatloom.operators import latent

    points, vectors = tables
    lam, runs = gp.heat(VALUES, 3.0), []
    for parts, every in ((2, 10), (5, 3)):
        latent.STORED_SWEEPS = every
        rows = TrainingRows(points, vectors.repartition(parts, "row_id"), K)
        state = rows.gibbs(lam, 0.3, 12, 1, average=True)
        runs.append(np.array([r["omega"] for r in state.orderBy("row_id").collect()]))
    latent.STORED_SWEEPS = 10
    assert np.allclose(*runs, atol=1e-9)
    label, own = rows.pg_weights(state, lam, 0.3)
    weight = gp.pg_weights(V, lam, 0.3, Y, TRIALS, runs[1])
    assert np.allclose(label, lam * (V.T @ weight)) and np.allclose([r["own"] for r in own.orderBy("row_id").collect()], weight)
    state = rows.gibbs(lam, 0.3, 40, 2, average=True)
    mean = np.array([r["omega"] for r in state.orderBy("row_id").collect()])
    want = np.mean([gp.gibbs(V, lam, 0.3, Y, TRIALS, 40, seed, average=True) for seed in range(12)], axis=0)
    assert mean.mean() == pytest.approx(want.mean(), rel=0.02) and np.corrcoef(mean, want)[0, 1] > 0.9


def test_keyed_numbers():
    """Moments, and the same numbers for a row among others."""
    for z in (0.0, 1.0, 4.0):
        x = polyagamma.draw_one(np.full(60_000, z), polyagamma.Keyed(3, np.arange(60_000), 2))
        assert x.mean() == pytest.approx(np.tanh(z / 2) / (2 * z) if z else 0.25, rel=0.02)
    every = polyagamma.draw_one(np.linspace(0, 5, 50), polyagamma.Keyed(3, np.arange(50), 7))
    some = polyagamma.draw_one(np.linspace(0, 5, 50)[10:20], polyagamma.Keyed(3, np.arange(10, 20), 7))
    assert (every[10:20] == some).all()
    normal = polyagamma.Keyed(1, np.arange(60_000), 0).normal(np.arange(60_000))
    assert abs(normal.mean()) < 0.02 and normal.std() == pytest.approx(1, rel=0.02)


def test_ahead_takes_the_same_points():
    for f in (lambda t: (np.log(t) - 3.3) ** 2, lambda t: t, lambda t: -t, lambda t: abs(np.log(t) + 2)):
        calls = []
        many = minimize_log_many(lambda xs: calls.append(len(xs)) or [f(x) for x in xs], 10.0, 1e-3)  # noqa: B023
        assert many == minimize_log(f, 10.0, 1e-3) and len(calls) < 12


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.4, (30, 2)), rng.normal(2, 0.4, (30, 2)), rng.normal((0, 3), 0.4, (30, 2))]
    return spark.createDataFrame([(i, x[i].tolist(), i % 2 == 0, float(i // 30)) for i in range(90)], "row_id long, x array<double>, is_train boolean, y double").persist()


def test_fits_in_tasks_equal_fits_on_the_driver(blobs, monkeypatch):
    from pyspark.sql import functions as F

    binary = blobs.withColumn("y", (F.col("y") > 0).cast("double"))
    by_id = lambda fit: fit.predictions.orderBy("row_id").toPandas()
    near = fits.fit_logit(binary, "lae", s=12, k=5, sweeps=20, average=True)
    many = fits.fit_multinomial(blobs, "se", s=12, k=4, a2s=[2.0], sweeps=4)
    line = blobs.withColumn("y", F.sin(2 * F.col("x")[0]) + F.col("x")[1] ** 2 + 0.3 * F.sin(37.0 * F.col("row_id")))
    rbf, _ = fits.fit_rbf_regression(line, 8)
    monkeypatch.setattr(fits, "MAX_TRAIN_VALUES", 0)
    far = fits.fit_logit(binary, "lae", s=12, k=5, sweeps=20, average=True)
    assert far.params["t"] == pytest.approx(near.params["t"], rel=1e-6) and far.params["objective"] == pytest.approx(near.params["objective"], abs=1e-6)
    a, b = by_id(near), by_id(far)
    assert np.allclose(a["mean"], b["mean"], atol=1e-6) and np.allclose(a["var"], b["var"], atol=1e-6)
    assert (a["y_pred"] == b["y_pred"]).mean() > 0.95 and np.corrcoef(a["pi"], b["pi"])[0, 1] > 0.98
    far = fits.fit_multinomial(blobs, "se", s=12, k=4, a2s=[2.0], sweeps=4)
    other, rows = fits.fit_rbf_regression(line, 8)
    assert other.objective == pytest.approx(rbf.objective, rel=1e-3) and np.allclose(other.predict(np.eye(2)), rbf.predict(np.eye(2)), atol=1e-2) and rows.count() == 90
    assert far.params["a2"] == many.params["a2"] and np.allclose(far.params["t"], many.params["t"], rtol=1e-6)
    a, b = by_id(many), by_id(far)
    assert np.allclose(np.stack(a["mean"]), np.stack(b["mean"]), atol=1e-6) and np.allclose(np.stack(a["var"]), np.stack(b["var"]), atol=1e-6)


def test_labels_that_are_refused(blobs):
    from pyspark.sql import functions as F

    for wrong in (F.lit(None).cast("double"), F.lit(-1.0), F.lit(2.5), F.lit(float("nan"))):
        odd = blobs.withColumn("y", F.when(F.col("row_id") == 4, wrong).otherwise(F.col("y") % 2))
        for fit in (fits.fit_logit, fits.fit_multinomial):
            with pytest.raises(ValueError):
                fit(odd, "lae", s=12, k=4)
    with pytest.raises(ValueError):
        fits.fit_logit(blobs.withColumn("is_train", F.lit(False)), "lae", s=12, k=4)


def test_newton_searches_of_many_rows_end(monkeypatch):
    """Rounding of all rows adds up to more than the tolerance; steps at that level are the last, on the driver and by sums."""
    from heatloom.functions.dense import cholesky
    from heatloom.operators import latent

    n, k = 20_000, 20
    rng = np.random.default_rng(1)
    own = rng.integers(0, k, n)
    v = np.zeros((n, k))
    v[np.arange(n), own] = np.sqrt(n / np.bincount(own, minlength=k))[own]
    y, solved = ((own % 2) ^ (np.arange(n) % 97 == 0)).astype(float), []
    counted = lambda c: solved.append(1) or cholesky(c)
    monkeypatch.setattr(gp, "cholesky", counted)
    near = gp.laplace_mode(v, np.ones(k), 0.5, y, np.ones(n), tol=1e-10)
    assert len(solved) < 20

    class Rows(latent.TrainingRows):
        passes, rows = 0, n

        def __init__(self):
            self.k = k

        def sums(self, searches):
            self.passes += 1
            (s,) = searches
            f, last = latent.replay(v, y, np.ones(n), s)
            pi = gp.sigmoid(f)
            weight, gap = pi * (1 - pi), y - pi
            b, share = weight * f + gap, weight / (1 + s.ridge * weight)
            return [latent.Sums.of(np.r_[(v.T @ (v * share[:, None])).ravel(), v.T @ b, v.T @ (share * b), v.T @ gap, last if s.steps else (0.0,) * 4], k)]

    far = Rows()
    evidence, search, _ = far.modes([latent.Search(np.ones(k), 0.5)], tol=1e-10)[0]
    assert far.passes < 20
    assert abs(evidence - near.evidence) < 1e-6 and np.abs(latent.replay(v, y, np.ones(n), search)[0] - near.f).max() < 1e-7
