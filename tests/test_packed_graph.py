"""Products of a full graph from packed blocks, and a block search that multiplies residuals only."""

import numpy as np

from heatloom.operators import graph as G
from heatloom.operators import multilevel


def test_products_from_packed_blocks(spark, monkeypatch):
    """rows of all lengths, cut into blocks of a few edges, are read as bytes."""
    rng = np.random.default_rng(2)
    a = np.where(rng.random((50, 50)) < np.linspace(0.02, 1, 50)[:, None], rng.random((50, 50)), 0.0) + np.eye(50)
    rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(a)]
    table = spark.createDataFrame(rows, "ip int, idx array<int>, w array<double>").repartition(3)
    block = rng.normal(size=(50, 3))
    for edges in (1, 60, 10_000):
        monkeypatch.setattr(G, "PACKED_EDGES", edges)
        blocks = G.packed(table, ["w"])
        assert dict(blocks.dtypes)["w"] == "binary" and (blocks.count() > 3) == (edges < 10_000)
        found = G.SparseRows(50, table=blocks)
        for long in (1, 1000):
            monkeypatch.setattr(G, "LONG_ROWS", long)
            np.testing.assert_allclose(found.times(block), a @ block, rtol=1e-12)
        np.testing.assert_array_equal(found.diagonal(), a.diagonal())
        np.testing.assert_array_equal(found.strongest(0.0), np.where((a - 2 * np.diag(a.diagonal())).max(1) > 0, (a - 2 * np.diag(a.diagonal())).argmax(1), np.arange(50)))


def test_search_multiplies_residuals_only():
    """the directions of the step before aren't multiplied again."""
    x = np.sort(np.random.default_rng(4).random(900))
    w = np.exp(-((x[:, None] - x) ** 2) / 0.01)
    root = np.sqrt(w.sum(1))
    w = w / root / root[:, None]

    class Counted(G.SparseRows):
        widths = []

        def times(self, block):
            Counted.widths.append(block.shape[1])
            return super().times(block)

    values, vectors = multilevel.leading_pairs(Counted(900, (np.arange(0, 900 * 900 + 1, 900), np.tile(np.arange(900), 900), w.ravel())), 20, root, tol=1e-9)
    want = np.linalg.eigvalsh(w)[::-1][:20]
    np.testing.assert_allclose(values, want, atol=1e-10)
    assert np.abs(w @ vectors - vectors * values).max() < 1e-8
    assert sum(width > 25 for width in Counted.widths[1:]) <= len(Counted.widths) // multilevel.FRESH
