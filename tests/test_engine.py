"""Operators and fits over DataFrames, against numpy and the published accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.functions.dense import local_weights, squared_distances
from heatloom.operators import metrics
from heatloom.operators.anchors import Anchors, subsample
from heatloom.operators.graph import edges, neighbor_count, subspace, walk
from heatloom.operators.neighbors import cluster_sizes, nearest_anchors, nearest_points
from heatloom.operators.nystrom import Nystrom
from heatloom.operators.spectrum import spectrum_from_weights
from heatloom.operators.weights import lae_weights, normalize
from heatloom.plans import fit as fits
from heatloom.sources import points as P
from heatloom.streaming.score import score_stream


def points(spark, x, y=None, train=None):
    rows = [(i, [float(v) for v in r], True if train is None else bool(train[i]), None if y is None else float(y[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, is_train boolean, y double")


X = np.random.default_rng(3).standard_normal((60, 3))


def by_id(df, column):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r["row_id"])])


def test_nearest_anchors_and_ties(spark):
    u = np.vstack([X[:5], X[:1]])  # a repeated anchor: the first number wins
    near = nearest_anchors(points(spark, X), u, 2)
    d2 = squared_distances(X, u)
    assert (by_id(near, "idx") == np.argsort(d2, axis=1, kind="stable")[:, :2]).all()
    assert by_id(near, "idx")[0].tolist() == [0, 5]
    assert cluster_sizes(points(spark, X), u)[5] == 0
    with pytest.raises(ValueError):
        nearest_anchors(points(spark, X), u, 7)


def test_nearest_points_in_blocks(spark):
    got = nearest_points(points(spark, X), 4, block=13)
    want = np.argsort(squared_distances(X, X), axis=1, kind="stable")[:, :4]
    assert [[e["row_id"] for e in r["nn"]] for r in sorted(got.collect(), key=lambda r: r["row_id"])] == want.tolist()


@pytest.mark.parametrize("gl", ["rw", "normalized", "cluster-normalized"])
def test_normalized_weights_and_spectrum(spark, gl):
    anchors = Anchors(X[:8], cluster_sizes(points(spark, X), X[:8]))
    z = normalize(lae_weights(points(spark, X), anchors.u, 3), anchors, gl)
    idx, w = by_id(z, "idx"), by_id(z, "w")
    assert np.allclose(w.sum(1), 1, atol=1e-6)
    dense = np.zeros((60, 8))
    np.put_along_axis(dense, idx, w, 1)
    a = dense / np.sqrt(dense.sum(0) + 1e-9)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    spec = spectrum_from_weights(z, 8, 4)
    assert np.allclose(spec.values, s[:4] ** 2, atol=1e-8) and spec.values[0] == pytest.approx(1, abs=1e-6)
    v = by_id(spec.vectors, "v")
    assert np.allclose(v @ v.T, 60 * u[:, :4] @ u[:, :4].T, atol=1e-6)
    assert np.allclose(spectrum_from_weights(z, 8, 4, root=True).values, s[:4], atol=1e-8)


def test_lae_with_one_anchor_and_all(spark):
    assert (by_id(lae_weights(points(spark, X), X[:4], 1), "w") == 1).all()
    w = by_id(lae_weights(points(spark, X), X[:4], 4), "w")
    order = np.argsort(squared_distances(X, X[:4]), axis=1, kind="stable")
    assert np.allclose(w, local_weights(X, X[:4][order]))


@pytest.mark.parametrize("method", ["kmeans", "random", "minibatchkmeans"])
def test_subsample(spark, method):
    a = subsample(points(spark, X), 6, method)
    assert a.u.shape == (6, 3) and a.size.sum() == 60
    few = subsample(points(spark, np.repeat(X[:3], 4, 0)), 12, "kmeans")
    assert len(few.u) == 3


def test_full_graph_matches_numpy(spark):
    pairs = edges(nearest_points(points(spark, X), 5)).persist()
    w = walk(pairs, 0.8)
    z = np.zeros((60, 60))
    for r in pairs.collect():
        z[r["i"], r["j"]] = np.exp(-r["d2"] / 0.8)
    z = (z + z.T) / 2
    d = z.sum(1) + 1e-9
    a = z / d[:, None] / d
    t = a.sum(1) + 1e-9
    want = a / np.sqrt(t)[:, None] / np.sqrt(t)
    got = np.zeros((60, 60))
    for r in w.collect():
        got[r["i"], r["j"]] = r["w"]
    assert np.allclose(got, want)
    values, _ = subspace(w.select("i", "j", "w"), np.arange(60), 4)
    assert np.allclose(values, np.linalg.eigvalsh(want)[::-1][:4], atol=1e-5)
    assert neighbor_count(250, 0.01) == 3 and neighbor_count(450, 0.01) == 5 and neighbor_count(2, 0.5) == 2


def test_nystrom_rows_sum_to_one():
    model = Nystrom.build(X[:10], 0.5, 4)
    assert np.allclose(model.weights(X).sum(1), 1, atol=1e-6)
    assert np.allclose(model.extend(X[:10]) / model.vectors, 1, atol=1e-6)


def test_bad_input_raises(spark):
    for bad in ([[1.0, float("nan")]], [[1.0, float("inf")]], [[1.0], [1.0, 2.0]], [None]):
        rows = [(i, x, True, 1.0) for i, x in enumerate(bad)]
        with pytest.raises(ValueError):
            P.check_points(spark.createDataFrame(rows, "row_id long, x array<double>, is_train boolean, y double"))
    with pytest.raises(ValueError):
        P.check_points(points(spark, X).limit(0))
    with pytest.raises(ValueError):
        fits.ModelSpec(kernel="other")
    with pytest.raises(ValueError):
        fits.fit_regression(points(spark, X, X[:, 0]), "lae", s=5, approach="other")
    with pytest.raises(ValueError):
        fits.fit_logit(points(spark, X, X[:, 0]), "other", s=5)


def test_small_fits_of_every_kind(spark):
    c = np.repeat([0.0, 5.0, -5.0], 13)
    x = np.random.default_rng(1).standard_normal((39, 3)) + c[:, None]
    train = np.arange(39) % 4 == 0
    three = points(spark, x, np.repeat([0, 1, 2], 13), train).persist()
    two = three.withColumn("y", (F.col("y") == 1).cast("double"))
    options = {"a2s": (0.5, 1.0)}
    for method in ("lae", "se", "nystrom", "gl"):
        size = {"k": 5} if method == "gl" else {"s": 6, "k": 5}
        extra = {} if method == "lae" else options
        got = fits.fit_multinomial(three, method, sweeps=20, **size, **extra).predictions.join(three.select("row_id", "y"), "row_id")
        assert got.where("y = y_pred").count() >= 33, method
        assert fits.fit_logit(two, method, sweeps=20, **size, **extra).predictions.join(two.select("row_id", "y"), "row_id").where("y = y_pred").count() >= 33, method
        assert fits.fit_regression(two, method, **size, **extra).predictions.where("var > 0").count() == 39


def test_array_labels_pointwise_noise_and_random_anchors(spark):
    y = X[:, 0] * 2
    one = points(spark, X, y, np.arange(60) % 2 == 0)
    both = one.withColumn("y", F.array("y", -F.col("y")))
    spec = fits.ModelSpec(subsample="random")
    got = fits.fit_regression(both, "lae", s=30, r=3, k=10, models=spec).predictions
    pairs = by_id(got, "y_pred")
    assert np.allclose(pairs[:, 0], -pairs[:, 1])
    noisy = fits.fit_regression(one, "lae", s=30, r=3, k=10, noise="different", models=spec)
    assert len(noisy.params["noise"]) == 30 and noisy.predictions.count() == 60
    h = noisy.covariance()
    assert h.count() == 60 * 30


def test_binomial_points(spark):
    x = np.r_[np.zeros((10, 2)), np.full((10, 2), 4.0)] + X[:20, :2] * 0.1
    rows = [(i, [float(a) for a in v], i % 2 == 0, 4.0 * (i >= 10), 4.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, is_train boolean, y double, n_trials double")
    got = fits.fit_logit(df, "lae", s=6, r=2, k=4, sweeps=20).predictions
    assert by_id(got, "y_pred").tolist() == [0.0] * 10 + [1.0] * 10


def test_published_accuracy(spark):
    ring = P.ring(spark).persist()
    out = fits.fit_lae_logit_gp(ring, 600, 3, 100).predictions.where("not is_train").join(ring.select("row_id", "y"), "row_id")
    assert out.agg(F.avg((F.col("y") != F.col("y_pred")).cast("double"))).first()[0] <= 0.05
    spiral = P.spiral(spark).persist()
    out = fits.fit_lae_regression_gp(spiral, 500, 3, 100).predictions.where("not is_train").join(spiral.select("row_id", "y"), "row_id")
    assert out.agg(F.sqrt(F.avg((F.col("y") - F.col("y_pred")) ** 2))).first()[0] <= 0.7


def test_nll(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 1.0), (2, 3.0, 0.5, 1.0)], "row_id long, mean double, var double, y double")
    m, v, y = np.array([0.0, 3.0]), np.array([1.0, 0.5]), np.ones(2)
    want = 0.5 * (np.mean((y - m) ** 2 / v + np.log(v)) + np.log(2 * np.pi))
    assert metrics.negative_log_likelihood(rows).first()[0] == pytest.approx(want, abs=1e-6)
    exact = metrics.negative_log_likelihood(rows, "binary", samples=0).first()[0]
    assert metrics.negative_log_likelihood(rows, "binary", samples=20_000).first()[0] == pytest.approx(exact, abs=0.01)
    many = rows.select("row_id", F.array("mean", "mean").alias("mean"), F.array("var", "var").alias("var"), F.lit(1).alias("y"))
    assert metrics.negative_log_likelihood(many, "multinomial", samples=0).first()[0] > exact
    with pytest.raises(ValueError):
        metrics.negative_log_likelihood(rows, "other")


def test_stream_scores_equal_table_scores(spark, tmp_path):
    table = points(spark, X)
    table.select("row_id", "x").write.parquet(str(tmp_path / "in"))
    model = Nystrom.build(X[:10], 0.5, 4)
    args = (model, np.arange(4.0), np.eye(4), 0.1)
    stream = spark.readStream.schema("row_id long, x array<double>").parquet(str(tmp_path / "in"))
    query = score_stream(stream, *args).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert np.allclose(by_id(spark.table("scored"), "mean"), by_id(score_stream(table, *args), "mean"))


def test_registered_functions(spark):
    from heatloom.functions.udfs import register

    register(spark)
    assert spark.sql("SELECT simplex_project(array(3D, 0D)) AS w").first()["w"] == [1.0, 0.0]
    assert sum(spark.sql("SELECT lae_weights(array(1D), array(array(0D), array(2D))) AS w").first()["w"]) == pytest.approx(1)
    assert spark.sql("SELECT heat_kernel(array(1D), array(2D), array(1D), 5D) AS h").first()["h"] == 2.0


def test_distributed_paths_equal_local_ones(spark, monkeypatch):
    from heatloom.operators import anchors as A
    from heatloom.operators import spectrum as S

    df = points(spark, X, X[:, 0], np.arange(60) % 2 == 0).persist()
    anchors = Anchors(X[:8], cluster_sizes(df, X[:8]))
    z = normalize(lae_weights(df, anchors.u, 3), anchors, "cluster-normalized").persist()
    near = spectrum_from_weights(z, 8, 4)
    fit = fits.fit_regression(df, "se", s=8, r=3, k=4, a2s=(0.5, 2.0), models=fits.ModelSpec(subsample="random"))
    monkeypatch.setattr(S, "LOCAL_VALUES", 0)
    monkeypatch.setattr(fits, "LOCAL_VALUES", 0)
    far = spectrum_from_weights(z, 8, 4)
    assert near.local and far.local is None and np.allclose(near.values, far.values)
    assert np.allclose(by_id(near.vectors, "v"), by_id(far.vectors, "v"), atol=1e-8)
    again = fits.fit_regression(df, "se", s=8, r=3, k=4, a2s=(0.5, 2.0), models=fits.ModelSpec(subsample="random"))
    assert np.allclose(by_id(fit.predictions, "y_pred"), by_id(again.predictions, "y_pred"), atol=1e-4)
    near_anchors = {m: subsample(df, 6, m, nstart=2) for m in ("kmeans", "minibatchkmeans")}
    monkeypatch.setattr(A, "LOCAL_VALUES", 0)
    for method, a in near_anchors.items():
        far_anchors = subsample(df.repartition(5), 6, method, nstart=2)
        assert np.allclose(a.u, far_anchors.u, atol=1e-9) and (a.size == far_anchors.size).all() and a.size.sum() == 60
    assert len(subsample(points(spark, np.repeat(X[:3], 4, 0)), 12, "kmeans").u) == 3
    rows = A.PointRows.of(df.repartition(5))
    assert np.allclose(rows.farthest(X[:2], 3), X[np.argsort(-squared_distances(X, X[:2]).min(1))[:3]])


def test_full_graph_by_jobs_equals_the_driver(spark, monkeypatch):
    """The eigenpairs of three sources: whole matrices, edges on the driver, edges in a table; and refusals before any work."""
    from heatloom.operators import graph as G
    from heatloom.operators import neighbors as N

    df = points(spark, X, X[:, 0], np.arange(60) % 2 == 0).persist()
    base = G.graph_base(df, 0.2, True)
    near = G.graph_eigen(df, base, 0.7, 5)
    monkeypatch.setattr(G, "LOCAL_EDGES", 0)
    far = G.graph_eigen(df, G.graph_base(df, 0.2, True), 0.7, 5)
    assert base.local and np.allclose(near.values, far.values) and np.allclose(near.local[1], far.local[1], atol=1e-4)
    w = walk(edges(nearest_points(df, neighbor_count(60, 0.2))), 0.7 * base.mean)
    dense = np.zeros((60, 60))
    for r in w.collect():
        dense[r["i"], r["j"]] = r["w"]
    assert np.allclose(near.values, np.linalg.eigvalsh(dense)[::-1][:5], atol=1e-9)
    w = far_rows = G.SparseRows(60, table=G.by_rows(w.select("i", "j", "w"), np.arange(60), ["w"]).persist())
    near_rows = whole_rows(dense)
    label, share = np.arange(60) // 7, np.random.default_rng(2).random(60)
    p = np.zeros((60, 9))
    p[np.arange(60), label] = share
    for rows in (far_rows, near_rows, G.SparseRows(60, table=far_rows.table)):
        assert np.allclose(rows.diagonal(), np.diag(dense))
        beside = dense - np.diag(np.diag(dense))
        assert np.allclose(beside[np.arange(60), rows.strongest(0.0)], beside.max(1))
        small = rows.contracted(label, share, 9)
        assert np.allclose(small.times(np.eye(9)), p.T @ dense @ p)
        monkeypatch.setattr(G, "LOCAL_EDGES", 10_000)  # a table whose contraction comes to the driver
    monkeypatch.setattr(G, "BLOCK", 59)
    with pytest.raises(ValueError):
        G.graph_base(df, 0.2, True)
    monkeypatch.setattr(N, "MAX_COORDINATES", 179)
    with pytest.raises(ValueError):
        N.point_matrix(df)


def test_mini_batches_see_all_rows(spark):
    """Batches differ from step to step, together hold every row, and their share is as asked for."""
    from heatloom.operators import anchors as A

    rows = A.PointRows.of(points(spark, X))
    drawn = [{tuple(r) for r in rows.part(step, 4, 0)} for step in range(40)]
    assert len(set().union(*drawn)) == 60 and len({frozenset(d) for d in drawn}) > 30 and 10 < np.mean([len(d) for d in drawn]) < 20


def whole_rows(a):
    """A dense matrix as sparse rows."""
    from heatloom.operators.graph import SparseRows

    n = len(a)
    return SparseRows(n, (np.arange(0, n * n + 1, n), np.tile(np.arange(n), n), a.ravel()))


def test_leading_pairs_with_repeated_and_close_eigenvalues(monkeypatch):
    from heatloom.operators import multilevel

    monkeypatch.setattr(multilevel, "COARSE", 40)
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    for values in (np.r_[np.ones(9), 1 - np.logspace(-3, -0.1, 391)], np.r_[1.0, 1 - np.linspace(0.01, 1.9, 399)]):
        a = (basis * values) @ basis.T
        for k in (3, 15):
            found, vectors = multilevel.leading_pairs(whole_rows(a), k)
            assert np.allclose(found, np.sort(values)[::-1][:k], atol=1e-8)
            assert np.allclose(a @ vectors, vectors * found, atol=2e-6) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-8)
    with pytest.raises(FloatingPointError):
        multilevel.leading_pairs(whole_rows(a), 15, rounds=2)


def test_leading_pairs_of_nearly_disconnected_graphs():
    """Clusters of many sizes, tied by weights down to nothing: eigenvalues as of the whole matrix, and contraction finds the components."""
    from heatloom.operators import multilevel
    from heatloom.operators.multilevel import leading_pairs, levels_of

    rng = np.random.default_rng(3)
    for between in (0.0, 1e-12, 1e-7, 1e-3):
        owner = np.sort(rng.integers(0, 60, 900))
        a = np.where(owner[:, None] == owner, rng.random((900, 900)) ** 4, between * rng.random((900, 900)))
        a = a + a.T + np.diag(rng.random(900))
        root = np.sqrt(a.sum(1))
        w = a / root[:, None] / root
        values, vectors = leading_pairs(whole_rows(w), 20, root)
        assert np.allclose(values, np.linalg.eigvalsh(w)[::-1][:20], atol=1e-7)
        assert np.abs(w @ vectors - vectors * values).max() < 1e-6
        if not between:
            label = np.arange(900)
            old, multilevel.COARSE = multilevel.COARSE, 1
            for level in levels_of(whole_rows(w), root)[:-1]:
                label = level.label[label]
            multilevel.COARSE = old
            assert len(np.unique(label)) == len(np.unique(owner)) == len(set(zip(label.tolist(), owner.tolist(), strict=True)))


def test_walk_of_documents_has_the_pairs_of_the_whole_matrix(spark):
    """Default bandwidths on a thousand real documents, all of which go through the block search."""
    from heatloom.operators import graph as G
    from heatloom.plans.fit import BANDWIDTHS
    from heatloom.sources.points import document_points

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    df = document_points(spark, "/root/testdata/sf0.01")
    base = G.graph_base(df, 0.01, True)
    assert len(base.ids) == 1000
    for a2 in BANDWIDTHS[::3]:
        walked, _ = base.scaled(a2 * base.mean)
        got = G.graph_eigen(df, base, a2, 20)
        assert np.allclose(got.values, np.linalg.eigvalsh(walked.times(np.eye(1000)))[::-1][:20], atol=1e-7)


def test_oversampled_seeding_costs_as_little_as_the_greedy_one(spark, monkeypatch):
    """Over several seeds the cost after k-means is within a twentieth of that from greedy draws, and so is that of the seeds themselves; in tasks the same seeds."""
    from heatloom.operators import anchors as A

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(rng.normal(0, 8, 2), rng.uniform(0.2, 1.5), (60, 2)) for _ in range(15)])
    rows = A.PointRows.of(points(spark, x).persist())
    cost = lambda c: float(rows.sums(c)[-1])
    ours = [A.seeding(rows, 30, seed) for seed in range(6)]
    greedy = [A.spread_out(x, 30, seed) for seed in range(6)]
    assert all(len(u) == 30 for u in ours) and np.mean([cost(u) for u in ours]) < 1.05 * np.mean([cost(u) for u in greedy])
    after = np.mean([A.lloyd(rows, 30, 100, seed)[1] for seed in range(6)])
    monkeypatch.setattr(A, "seeding", lambda rows, s, seed: A.spread_out(x, s, seed))
    assert after < 1.05 * np.mean([A.lloyd(rows, 30, 100, seed)[1] for seed in range(6)])
    monkeypatch.undo()
    far = A.PointRows(rows.points.repartition(3), rows.n, rows.d)
    assert np.allclose(A.seeding(far, 30, 0), ours[0])


def test_kernel_by_blocks_equals_the_sent_side(spark, monkeypatch):
    from heatloom.operators import spectrum as S

    rng = np.random.default_rng(2)
    make = lambda n, first: spark.createDataFrame([(first + i, rng.normal(size=4).tolist()) for i in range(n)], "row_id long, v array<double>").persist()
    left, right, values = make(23, 0), make(17, 10), np.array([1.0, 0.8, 0.5, 0.1])
    table = lambda: {(r["i"], r["j"]): r["h"] for r in S.heat_kernel(left, right, values, 2.0, 3).collect()}
    near = table()
    monkeypatch.setattr(S, "SENT_VALUES", 0)
    monkeypatch.setattr(S, "KERNEL_BLOCK", 5)
    far = table()
    assert len(near) == 23 * 17 and near.keys() == far.keys() and all(abs(near[k] - far[k]) < 1e-12 for k in near)
    assert S.heat_kernel(left, right.limit(0), values, 2.0).collect() == []
    own = {(r["i"], r["j"]): r["h"] for r in S.heat_kernel(left, left, values, 2.0, 3).collect()}  # both sides of one table
    one = {(r["i"], r["j"]): r["h"] for r in S.heat_kernel(left, left.where("row_id >= 10").select("v", "row_id"), values, 2.0, 3).collect()}
    monkeypatch.setattr(S, "SENT_VALUES", 10**6)
    near = {(r["i"], r["j"]): r["h"] for r in S.heat_kernel(left, left, values, 2.0, 3).collect()}
    assert len(near) == 23 * 23 and near.keys() == own.keys() and all(abs(near[k] - own[k]) < 1e-12 for k in near)
    assert len(one) == 23 * 13 and all(abs(near[k] - one[k]) < 1e-12 for k in one)


def test_heat_kernel_query_of_blocks(spark, sf_dir, monkeypatch):
    """Both sides are one table, whose columns had other names before."""
    from heatloom.operators import spectrum as S
    from heatloom.plans.queries import QUERIES

    total = lambda: tuple(round(x, 3) for x in QUERIES["q_heat_kernel"](spark, sf_dir).agg(F.count("*"), F.sum("h"), F.sum(F.col("h") * F.col("i")), F.sum(F.col("h") * F.col("j"))).first())
    near = total()
    monkeypatch.setattr(S, "SENT_VALUES", 64 * 100)
    assert total() == near


def test_block_means_take_no_training_rows_to_the_driver(spark, sf_dir, monkeypatch):
    """A covariance of all training rows would be quadratic in them."""
    from heatloom.functions import gp
    from heatloom.plans.queries import QUERIES

    sizes, solve = [], gp.cholesky
    monkeypatch.setattr(gp, "cholesky", lambda c: sizes.append(len(c)) or solve(c))
    assert QUERIES["q_gp_mean_blocks"](spark, sf_dir).count() == 500
    assert sizes and max(sizes) <= 20
