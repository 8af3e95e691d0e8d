"""Fits whose rows repeat: the constant eigenpair of a full graph, and Newton searches over distinct rows."""

import numpy as np

from heatloom.functions import gp
from heatloom.operators import graph as G
from heatloom.plans import fit as fits


def test_the_leading_pair_of_a_full_graph_needs_no_graph(spark, monkeypatch):
    """The same predictions as from the graph's own search, and also beyond the points that a graph takes."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), i % 2 == 0, float(v[0] > 0.3)) for i, v in enumerate(rng.normal(0, 1, (50, 3)))]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, is_train boolean, y double").persist()
    walked = G.graph_eigen(df, G.graph_base(df, 0.2, True), 1.0, 1)
    assert np.isclose(walked.values[0], 1, atol=1e-6) and np.allclose(walked.local[1], 1, atol=1e-6)
    want = fits.fit_logit(df, "gl", k=1, a2s=(1.0,))
    monkeypatch.setattr(fits, "candidates", lambda *_: fits.Candidates([1.0], lambda _: walked, lambda _: walked))
    whole = fits.fit_logit(df, "gl", k=1, a2s=(1.0,))
    monkeypatch.undo()
    by_id = lambda f: np.array([[r["mean"], r["var"], r["is_train"]] for r in f.predictions.orderBy("row_id").collect()], float)
    assert np.allclose(by_id(want), by_id(whole), atol=1e-4)
    monkeypatch.setattr(G, "BLOCK", 10)
    assert np.allclose(by_id(fits.fit_logit(df, "gl", k=1, a2s=(1.0,))), by_id(want))


def test_a_search_over_times_starts_from_the_mode_before(monkeypatch):
    """The same time and evidence as by searches from zero, in less than two thirds of their steps; a start that leads nowhere is given up."""
    rng = np.random.default_rng(0)
    v, values, ones = np.c_[np.ones(9000), rng.standard_normal((9000, 5))], 1 - np.linspace(0, 0.9, 6), np.ones(9000)
    y = (gp.sigmoid(v @ rng.normal(0, 0.5, 6)) > rng.random(9000)).astype(float)
    steps, settled, mode = [0], gp.settled, gp.laplace_mode

    def counted(*numbers):
        steps[0] += 1
        return settled(*numbers)

    monkeypatch.setattr(gp, "settled", counted)
    t, evidence = gp.best_time(v, values, y, ones, 1e-3, "posterior")
    warm, steps[0] = steps[0], 0
    monkeypatch.setattr(gp, "laplace_mode", lambda *a, start=None: mode(*a))
    assert np.allclose((t, evidence), gp.best_time(v, values, y, ones, 1e-3, "posterior"), rtol=1e-3) and warm < 2 / 3 * steps[0]
    far = mode(v, values, 0.1, y, ones, start=1e3 * rng.standard_normal(9000))
    assert np.isclose(far.evidence, mode(v, values, 0.1, y, ones).evidence) and np.allclose(far.f, mode(v, values, 0.1, y, ones).f, atol=1e-6)
