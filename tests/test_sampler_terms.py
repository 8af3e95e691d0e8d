"""A sampler that works on undecided draws only."""

import numpy as np
import pytest

from heatloom.functions import polyagamma


def test_terms_of_decided_draws_are_left_out(monkeypatch):
    """F6, F7, F8: all draws need one term or two, few need more."""
    seen, term = [], polyagamma._term
    monkeypatch.setattr(polyagamma, "_term", lambda n, x: seen.append(len(x)) or term(n, x))
    draws = polyagamma.draw_one(np.full(20_000, 0.5), np.random.default_rng(1))
    assert sum(seen) < 2.2 * 20_000
    assert draws.mean() == pytest.approx(np.tanh(0.25), abs=0.01)
