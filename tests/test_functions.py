"""Dense algebra against finite differences, whole matrices and known moments."""

import numpy as np
import pytest

from heatloom.functions import dense, gp, polyagamma

RNG = np.random.default_rng(7)


def spectrum(m=40, k=8):
    v = RNG.standard_normal((m, k))
    return v, np.sort(RNG.uniform(0.2, 1.0, k))[::-1]


def test_simplex_projection_is_nearest():
    v = RNG.standard_normal((50, 6)) * 3
    z = dense.project_simplex(v)
    assert (z >= 0).all() and np.allclose(z.sum(1), 1)
    others = RNG.dirichlet(np.ones(6), (200,))
    for i in range(50):
        assert ((v[i] - z[i]) ** 2).sum() <= ((v[i] - others) ** 2).sum(1).min() + 1e-12


def test_local_weights_meet_optimality():
    x, u = RNG.standard_normal((30, 4)), RNG.standard_normal((30, 3, 4))
    w = dense.local_weights(x, u, tol=1e-18, steps=500)
    assert (w >= 0).all() and np.allclose(w.sum(1), 1)
    grad = -np.einsum("nrd,nd->nr", u, x - np.einsum("nr,nrd->nd", w, u))
    low = grad.min(1)
    assert (np.abs(np.where(w > 1e-6, grad - low[:, None], 0)) < 1e-4).all()


def test_local_weights_with_equal_anchors_end():
    u = np.ones((2, 3, 2))
    assert np.allclose(dense.local_weights(np.array([[1.0, 1], [5, 5]]), u).sum(1), 1)


@pytest.mark.parametrize("k", [3, 30])
def test_regression_moments_equal_whole_matrices(k):
    v, values = spectrum(20, k)
    y, t, noise, sigma = RNG.standard_normal((20, 2)), 0.7, 0.3, 1e-3
    c = v * gp.heat(values, t) @ v.T + (noise + sigma) * np.eye(20)
    whole = 0.5 * np.trace(y.T @ np.linalg.solve(c, y)) / 2 + 0.5 * np.linalg.slogdet(c)[1]
    value, grad = gp.regression_nmll(gp.Moments.of(v, y), values, t, noise, sigma)
    assert value == pytest.approx(whole)
    for i, step in enumerate((np.array([1e-5, 0]), np.array([0, 1e-5]))):
        up, down = (gp.regression_nmll(gp.Moments.of(v, y), values, *(np.array([t, noise]) + s * step), sigma)[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-4)


def test_pointwise_gradient():
    v, values = spectrum(12, 5)
    y, x = RNG.standard_normal((12, 1)), np.r_[0.8, RNG.uniform(0.2, 1, 12)]
    _, grad = gp.pointwise_nmll(v, y, values, x[0], x[1:], 1e-3)
    for i in range(13):
        e = np.eye(13)[i] * 1e-5
        up, down = (gp.pointwise_nmll(v, y, values, (x + s * e)[0], (x + s * e)[1:], 1e-3)[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_regression_predictions_equal_whole_matrices():
    v, values = spectrum(30, 6)
    y = RNG.standard_normal((30, 1))
    fit = gp.fit_regression(gp.Moments.of(v, y), values, 1e-4)
    lam = gp.heat(values, fit.t)
    c = v * lam @ v.T + (fit.noise + 1e-4) * np.eye(30)
    new = RNG.standard_normal((5, 6))
    cross = new * lam @ v.T
    assert np.allclose(new @ fit.mean, gp.predict_regression(c, y, cross))
    assert np.allclose(np.diag(new @ fit.spread @ new.T) + fit.floor, np.diag(new * lam @ new.T) - np.diag(cross @ np.linalg.solve(c, cross.T)) + fit.floor)


def test_laplace_low_rank_equals_whole():
    v, values = spectrum(25, 5)
    y, trials, lam, sigma = (RNG.uniform(size=25) > 0.5).astype(float), np.ones(25), gp.heat(values, 0.5), 0.05
    c = v * lam @ v.T + sigma * np.eye(25)
    low = gp.laplace_mode(v, lam, sigma, y, trials)
    assert low.evidence == pytest.approx(gp.marginal_log_likelihood_logit(c, y), abs=1e-6)
    fit = gp.fit_logit(v, values, y, trials, sigma, sweeps=5)
    lam = gp.heat(values, fit.t)
    new = RNG.standard_normal((4, 5))
    mean, var = gp.posterior_classification(v * lam @ v.T + sigma * np.eye(25), new * lam @ v.T, (new * lam * new).sum(1) + sigma, y)
    assert np.allclose(new @ fit.mean, mean, atol=1e-4)
    assert np.allclose(np.diag(new @ fit.spread @ new.T) + sigma, var, atol=1e-4)


def test_binomial_trials_count():
    c = np.eye(3)
    once = gp.marginal_log_likelihood_logit(c, np.array([1.0, 0, 1]))
    assert gp.marginal_log_likelihood_logit(c, np.array([3.0, 0, 3]), np.full(3, 3.0)) < once


def test_single_class_labels_are_fitted():
    v, values = spectrum(10, 3)
    fit = gp.fit_logit(v, values, np.ones(10), np.ones(10), sweeps=3)
    assert np.isfinite(fit.label).all()


def test_polya_gamma_moments():
    rng = np.random.default_rng(0)
    for z in (0.0, 0.5, 2.0, 8.0):
        x = polyagamma.draw_one(np.full(40_000, z), rng)
        mean = 0.25 if z == 0 else np.tanh(z / 2) / (2 * z)
        assert x.mean() == pytest.approx(mean, rel=0.02) and (x > 0).all()
    assert polyagamma.draw(np.full(20_000, 3), np.zeros(20_000), rng).mean() == pytest.approx(0.75, rel=0.02)


def test_pg_labels_follow_the_data():
    x = np.r_[RNG.normal(0, 1, 20), RNG.normal(6, 1, 20)]
    c = np.exp(-((x[:, None] - x) ** 2) / 8) + 1e-3 * np.eye(40)
    y = (np.arange(40) >= 20).astype(float)
    assert (gp.predict_pg_binary(c, y, c) == y).mean() > 0.9


def test_minimizers():
    assert dense.minimize_log(lambda t: (np.log(t) - 3) ** 2, 10.0, 1e-3)[0] == pytest.approx(np.exp(3), rel=1e-3)
    assert dense.minimize_log(lambda t: t, 10.0, 1e-3)[0] == pytest.approx(1e-3)
    x, value = dense.minimize_positive(lambda x: (((x - [2, 0.5]) ** 2).sum(), 2 * (x - [2, 0.5])), np.array([5.0, 5.0]), np.array([0.1, 1.0]))
    assert np.allclose(x, [2, 1], atol=1e-3) and value == pytest.approx(0.25, abs=1e-4)
    with pytest.raises(FloatingPointError):
        dense.minimize_log(lambda t: np.nan, 1.0, 0.1)


def test_cholesky_raises():
    with pytest.raises(np.linalg.LinAlgError):
        dense.cholesky(-np.eye(3))


def test_heat_kernel_shrinks_with_time():
    v, values = spectrum(10, 4)
    kernels = [v * gp.heat(values, t) @ v.T for t in (0, 1, 5)]
    assert np.allclose(kernels[0], v @ v.T)
    assert np.linalg.eigvalsh(kernels[1]).min() > -1e-9 and np.trace(kernels[2]) < np.trace(kernels[1]) < np.trace(kernels[0])


def test_subset_of_regressors():
    from heatloom.functions import rbf

    x = np.sort(RNG.uniform(-3, 3, 60))[:, None]
    y = np.sin(2 * x) + 0.1 * RNG.standard_normal((60, 1))
    u = x[::5]
    d2_xu, d2_uu = dense.squared_distances(x, u), dense.squared_distances(u, u)
    z = RNG.uniform(0.1, 0.5, 60)
    value, grad, weights = rbf.evidence(d2_xu, d2_uu, y, 0.3, z)
    c, k = rbf.kernel(d2_xu, 0.3), rbf.kernel(d2_uu, 0.3) + 1e-8 * np.eye(12)
    whole = c @ np.linalg.solve(k, c.T) + np.diag(z)
    assert value == pytest.approx((0.5 * y.T @ np.linalg.solve(whole, y)).item() + 0.5 * np.linalg.slogdet(whole)[1], rel=1e-5)
    assert np.allclose(c @ weights, c @ np.linalg.solve(k, c.T) @ np.linalg.solve(whole, y), atol=1e-4)
    for i in (0, 30):
        e = np.eye(60)[i] * 1e-5
        up, down = (rbf.evidence(d2_xu, d2_uu, y, 0.3, z + s * e)[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-5)
    for noise in ("same", "different"):
        fit = rbf.fit_rbf(x, y, u, noise=noise)
        assert np.sqrt(((fit.predict(x) - np.sin(2 * x)) ** 2).mean()) < 0.15
    with pytest.raises(ValueError):
        rbf.fit_rbf(x, y, u, noise="other")


def test_rbf_by_sums_equals_rbf_by_rows():
    from heatloom.functions import rbf

    rng = np.random.default_rng(8)
    x, u = rng.normal(size=(80, 2)), rng.normal(size=(9, 2))
    y = np.sin(x[:, :1]) + 0.1 * rng.normal(size=(80, 1))
    d2_xu, d2_uu = dense.squared_distances(x, u), dense.squared_distances(u, u)
    value, by_row, weights = rbf.evidence(d2_xu, d2_uu, y, 0.7, np.full(80, 0.2))
    got, by_noise, other = rbf.evidence_of_sums(rbf.RbfSums.of(rbf.RbfSums.flat(x, y, u, 0.7), 9), d2_uu, 0.7, 0.2)
    assert got == pytest.approx(value) and by_noise == pytest.approx(by_row.sum()) and np.allclose(other, weights, atol=1e-6)
    near = rbf.fit_rbf(x, y, u)
    far = rbf.fit_rbf_by_sums(lambda ts: [rbf.RbfSums.of(rbf.RbfSums.flat(x, y, u, t), 9) for t in ts], u)
    assert far.t == pytest.approx(near.t, rel=1e-3) and far.noise == pytest.approx(near.noise, rel=1e-3)
    assert np.allclose(near.predict(x), far.predict(x), atol=1e-3)
