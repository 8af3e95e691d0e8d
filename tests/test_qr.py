import numpy as np
import pytest

from heatloom.operators import qr
from heatloom.operators import spectrum as S


def weights(spark, n, s, r, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    idx = np.argsort(rng.random((n, s)), axis=1)[:, :r]
    w = rng.random((n, r)) * 10.0 ** -rng.integers(0, 3, (n, r))
    w /= w.sum(1, keepdims=True)
    df = spark.createDataFrame([(i, idx[i].tolist(), w[i].tolist()) for i in range(n)], "row_id long, idx array<int>, w array<double>").repartition(parts)
    return df.persist(), qr.dense(idx, w, s)


def test_squeezed_rows_keep_inner_products():
    rng = np.random.default_rng(1)
    key, rows = rng.integers(0, 6, 200), rng.normal(size=(200, 3))
    got, few = qr.squeeze(key, rows)
    assert np.bincount(got).max() <= 3
    for k in range(6):
        assert np.allclose(few[got == k].T @ few[got == k], rows[key == k].T @ rows[key == k])
    assert len(qr.squeeze(key[:0], rows[:0])[0]) == 0


def test_triangle_over_tasks_has_the_singular_values(spark, monkeypatch):
    z, a = weights(spark, 400, 12, 3)
    scale = np.linspace(0.5, 2, 12)
    want = np.linalg.svd(a * scale, compute_uv=False)
    assert np.allclose(np.linalg.svd(qr.triangle(z, scale), compute_uv=False), want, rtol=1e-12)
    monkeypatch.setattr(qr, "HELD_ROWS", 10)
    monkeypatch.setattr(qr, "FAN", 2)
    assert np.allclose(np.linalg.svd(qr.triangle(z, scale), compute_uv=False), want, rtol=1e-12)
    assert not qr.triangle(z.limit(0), scale).any()


def test_few_rows_and_repeated_anchors(spark):
    z = spark.createDataFrame([(0, [1, 1], [0.25, 0.5]), (1, [0, 1], [1.0, 2.0])], "row_id long, idx array<int>, w array<double>")
    r = qr.triangle(z, np.ones(4))
    assert np.allclose(r.T @ r, np.array([[1, 2, 0, 0], [2, 4.5625, 0, 0], [0] * 4, [0] * 4]))


@pytest.mark.parametrize("local", [True, False])
def test_small_singular_values_are_right(spark, monkeypatch, local):
    """Two anchors that all points weigh nearly alike give a value of some 1e-9 of the largest, which squares can't tell from none."""
    rng = np.random.default_rng(3)
    n, s = 300, 6
    w = rng.random((n, s)) + 0.1
    w[:, 5] = w[:, 4] * (1 + 1e-8 * rng.normal(size=n))
    w /= w.sum(1, keepdims=True)
    z = spark.createDataFrame([(i, list(range(s)), w[i].tolist()) for i in range(n)], "row_id long, idx array<int>, w array<double>").repartition(4).persist()
    if not local:
        monkeypatch.setattr(S, "LOCAL_VALUES", 0)
    a = w / np.sqrt(w.sum(0) + 1e-9)
    u, sigma, _ = np.linalg.svd(a, full_matrices=False)
    assert sigma[5] < 1e-7 * sigma[0]
    got = S.spectrum_from_weights(z, s, -1, root=True)
    assert len(got.values) == s and np.allclose(got.values, sigma, rtol=1e-6)
    v = np.array([r["v"] for r in got.vectors.orderBy("row_id").collect()])
    assert np.allclose(v @ v.T / n, u @ u.T, atol=1e-6)
    assert len(S.spectrum_from_weights(z, s, 3).values) == 3
