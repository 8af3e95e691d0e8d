"""Searches over bandwidths in tasks."""

import numpy as np
import pytest

from heatloom.plans import fit as fits

RNG = np.random.default_rng(5)
X = RNG.normal(size=(300, 3))


def table(spark, classes=2):
    y = (X[:, 0] > 0).astype(float) + (X[:, 1] > 0.5) * (classes > 2)
    rows = [(i, [float(v) for v in x], i % 2 == 0, float(t)) for i, (x, t) in enumerate(zip(X, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, is_train boolean, y double").repartition(3)


@pytest.mark.parametrize("method", ["nystrom", "se"])
@pytest.mark.parametrize("classes", [2, 3])
def test_bandwidths_are_searched_in_tasks(spark, monkeypatch, method, classes):
    """F7, F8, F9, F11: all bandwidths and classes are tasks of one job, with the driver's results."""
    fit = fits.fit_logit if classes == 2 else fits.fit_multinomial
    options = {"s": 12, "k": 5, "a2s": (0.5, 1.0, 2.0), "sweeps": 3}
    near = fit(table(spark, classes), method, **options).params
    sizes, run = [], fits.run_tasks
    monkeypatch.setattr(fits, "run_tasks", lambda s, f, items: sizes.append(len(items)) or run(s, f, items))
    monkeypatch.setattr(fits, "SEARCHED_VALUES", 0)
    far = fit(table(spark, classes), method, **options).params
    assert sizes[0] == 3 * (1 if classes == 2 else classes)
    assert far["a2"] == near["a2"]
    np.testing.assert_allclose(far["t"], near["t"], rtol=1e-6)
    sizes.clear()
    monkeypatch.setattr(fits, "STACKED_VALUES", 1)
    assert fit(table(spark, classes), method, **options).params["a2"] == near["a2"]
