"""The registered queries of the manifold operators, with independent SQL where SQL can express them.

Points are all rows of a table. Anchors are a sample in the order of a fixed key, which both sides can compute.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import gp
from heatloom.functions.dense import project_simplex
from heatloom.operators import metrics
from heatloom.operators.anchors import Anchors, hash_sample, subsample
from heatloom.operators.graph import edges, walk
from heatloom.operators.latent import Search, TrainingRows
from heatloom.operators.neighbors import cluster_sizes, nearest_anchors, nearest_points
from heatloom.operators.nystrom import Nystrom
from heatloom.operators.spectrum import Spectrum, gram_pairs, heat_kernel, spectrum_from_weights
from heatloom.operators.weights import cross_similarity_lae, lae_weights, mean_distance, normalize, se_weights
from heatloom.plans import fit as fits
from heatloom.plans.flagship import document_quality
from heatloom.sources.points import LETTERS, TEXT_FEATURES, WORDS, document_points, embedding_points, read_table

S, R, A2, EPSILON, NEAR = 20, 3, 0.5, 0.5, 5
#: The ridge of the Newton queries: large, so that rows differ from what they share.
NEWTON_RIDGE = 0.5
KEY = "(row_id * 2654435761) % 1000003"
#: Steps that make weights exact to the digits that are compared; a diffusion time, a noise, and two eigenvalues.
EXACT, TIME, NOISE, PAIR = {"tol": 1e-18, "steps": 2000}, 1.5, 0.3, np.array([1.0, 0.5])


def _six(column, name: str):
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def _cut(column, digits: int, name: str):
    """Rounded by arithmetic: for results of many pairs of rows, where decimal rounding costs more than all else."""
    return (F.rint(column * 10.0**digits) / 10.0**digits + F.lit(0.0)).alias(name)


def _anchors(points: DataFrame) -> Anchors:
    u = np.array([r["x"] for r in hash_sample(points, S, key=KEY).select("x").collect()])
    return Anchors(u, cluster_sizes(points, u))


def _near(spark: SparkSession, sf_dir: str, r: int = R) -> tuple[DataFrame, Anchors, DataFrame]:
    points = embedding_points(spark, sf_dir)
    anchors = _anchors(points)
    return points, anchors, nearest_anchors(points, anchors.u, r)


def _long(z: DataFrame, value: str, name: str) -> DataFrame:
    pairs = z.select("row_id", F.explode(F.arrays_zip("idx", value)).alias("e"))
    return pairs.select("row_id", F.col("e.idx").cast("long").alias("anchor_id"), _six(F.col(f"e.{value}"), name))


def q_random_anchor(spark, sf_dir):
    rows = hash_sample(embedding_points(spark, sf_dir), S, key=KEY)
    return rows.select("row_id", _six(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), "norm2"))


def q_sqdist(spark, sf_dir):
    return _long(_near(spark, sf_dir, S)[2], "d2", "d2")


def q_knn(spark, sf_dir):
    near = _near(spark, sf_dir)[2].select("row_id", F.posexplode(F.arrays_zip("idx", "d2")).alias("p", "e"))
    return near.select("row_id", (F.col("p") + 1).cast("long").alias("rank"), F.col("e.idx").cast("long").alias("anchor_id"), _six(F.col("e.d2"), "d2"))


def q_cluster_size(spark, sf_dir):
    anchors = _near(spark, sf_dir)[1]
    return anchors.frame(spark).select(F.col("anchor_id").cast("long").alias("anchor_id"), "cluster_size")


def q_lloyd_step(spark, sf_dir):
    points, _, near = _near(spark, sf_dir, 1)
    own = near.select("row_id", F.col("idx")[0].cast("long").alias("anchor_id")).join(points, "row_id")
    each = own.select("anchor_id", F.posexplode("x").alias("k", "v"))
    return each.groupBy("anchor_id", F.col("k").cast("long").alias("k")).agg(_six(F.avg("v"), "center"))


def q_se_weight(spark, sf_dir):
    near = _near(spark, sf_dir)[2]
    return _long(se_weights(near, 4 * EPSILON**2), "w", "w")


def q_se_grid_weight(spark, sf_dir):
    near = _near(spark, sf_dir)[2]
    return _long(se_weights(near, A2 * mean_distance(near)), "w", "w")


def _normalized(spark, sf_dir, gl: str) -> tuple[Anchors, DataFrame]:
    _, anchors, near = _near(spark, sf_dir)
    return anchors, normalize(se_weights(near, A2 * mean_distance(near)), anchors, gl)


def q_gl_rw(spark, sf_dir):
    return _long(_normalized(spark, sf_dir, "rw")[1], "w", "w")


def q_gl_normalized(spark, sf_dir):
    return _long(_normalized(spark, sf_dir, "normalized")[1], "w", "w")


def q_gl_cluster(spark, sf_dir):
    return _long(_normalized(spark, sf_dir, "cluster-normalized")[1], "w", "w")


def q_gram(spark, sf_dir):
    pairs = gram_pairs(_normalized(spark, sf_dir, "rw")[1])
    return pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _six(F.col("g"), "g"))


def q_sym_graph(spark, sf_dir):
    pairs = edges(nearest_points(embedding_points(spark, sf_dir), NEAR)).persist()  # the walk takes them several times, and all pairs are compared for them
    return walk(pairs, A2).select("i", "j", _six(F.col("w"), "w"))


def q_nystrom_weight(spark, sf_dir):
    points, anchors, _ = _near(spark, sf_dir)
    model = Nystrom.build(anchors.u, A2, 5)
    rows = fits.project(points.withColumnRenamed("x", "v"), "w array<double>", lambda _, x: [model.weights(x)])
    each = rows.select("row_id", F.posexplode("w").alias("a", "w"))
    return each.select("row_id", F.col("a").cast("long").alias("anchor_id"), _six(F.col("w"), "w"))


def q_simplex(spark, sf_dir):
    points = embedding_points(spark, sf_dir).withColumnRenamed("x", "v")
    each = fits.project(points, "w array<double>", lambda _, x: [project_simplex(4 * x)]).select("row_id", F.posexplode("w").alias("k", "w"))
    return each.select("row_id", F.col("k").cast("long").alias("k"), _six(F.col("w"), "w"))


def q_lae_pair(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    z = lae_weights(points, _anchors(points).u, 2, tol=1e-18, steps=400)
    first = z.select("row_id", F.col("idx")[0].cast("long").alias("anchor_id"), F.col("w")[0].alias("w"))
    return first.select("row_id", "anchor_id", F.round("w", 4).alias("w"))


def q_heat_kernel(spark, sf_dir):
    """Of all points with each other, with all coordinates as eigenvectors."""
    vectors = embedding_points(spark, sf_dir).select("row_id", F.col("x").alias("v"))
    return heat_kernel(vectors, vectors, 1 / (1 + np.arange(64.0)), 1.5).select("i", "j", _cut(F.col("h"), 6, "h"))


def q_label(spark, sf_dir):
    vectors = embedding_points(spark, sf_dir).select("row_id", F.slice("x", 1, 4).alias("v"))
    out = fits.project(vectors, "pi double, y_pred double", lambda _, v: [p := gp.sigmoid(v @ np.array([1.0, -2.0, 3.0, -4.0])), (p > 0.5).astype(float)])
    return out.select("row_id", _six(F.col("pi"), "pi"), "y_pred")


def q_one_vs_rest(spark, sf_dir):
    out = fits.one_vs_rest(embedding_points(spark, sf_dir), 10, "label")
    return out.select("row_id", F.col("class").cast("long").alias("class"), "y")


def q_argmax(spark, sf_dir):
    out = fits.project(embedding_points(spark, sf_dir).withColumnRenamed("x", "v"), "y_pred int", lambda _, v: [v.argmax(1).astype(np.int32)])
    return out.select("row_id", F.col("y_pred").cast("long").alias("y_pred"))


def q_nll_regression(spark, sf_dir):
    rows = embedding_points(spark, sf_dir).select("row_id", F.col("x")[0].alias("y"), F.col("x")[1].alias("mean"), (1 + F.abs(F.col("x")[2])).alias("var"))
    return metrics.negative_log_likelihood(rows, "regression").select(_six(F.col("nll"), "nll"))


def q_gp_mean(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    two = np.array([r["x"] for r in hash_sample(points, 2, key=KEY).select("x").collect()])
    c, y = two @ two.T + 0.5 * np.eye(2), np.array([1.0, -1.0])
    out = fits.project(points.withColumnRenamed("x", "v"), "y_pred double", lambda _, v: [gp.predict_regression(c, y, v @ two.T)])
    return out.select("row_id", _six(F.col("y_pred"), "y_pred"))


def q_laplace_mode(spark, sf_dir):
    labels = [r["label"] for r in embedding_points(spark, sf_dir).select("label").distinct().orderBy("label").collect()]
    c = np.array(labels, float) + 1
    mode = gp.laplace_mode(np.diag(np.sqrt(c)), np.ones(len(c)), 0.0, np.array(labels) % 2.0, np.ones(len(c)), tol=1e-12)
    return spark.createDataFrame([(int(k), round(float(f), 6) + 0.0) for k, f in zip(labels, mode.f, strict=True)], "label long, f double")


def _one_hot(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Points with labels by sign of their anchor's first coordinate (every 97th turned), and their vectors: one-hot by nearest of random anchors, times the root of the points over the anchor's own."""
    points = embedding_points(spark, sf_dir)
    anchors = subsample(points, S, "random")
    up = (anchors.u[:, 0] > 0).astype(int)
    own = nearest_anchors(points, anchors.u, 1).select("row_id", F.col("idx")[0].alias("own")).persist()
    scale = np.sqrt(anchors.size.sum() / np.maximum(anchors.size, 1))
    entry = F.transform(F.lit(list(range(S))), lambda a: F.when(a == F.col("own"), F.element_at(F.lit(scale.tolist()), F.col("own") + 1)).otherwise(0.0))
    label = F.pmod(F.element_at(F.lit(up.tolist()), F.col("own") + 1) + (F.col("row_id") % 97 == 0).cast("int"), F.lit(2)).cast("double")
    rows = points.select("row_id", F.col("x")[0].alias("x0"), (F.col("row_id") % 2 == 0).alias("is_train")).join(own.select("row_id", label.alias("y")), "row_id")
    return rows, own.select("row_id", "own", entry.alias("v"))


def _newton(spark, sf_dir) -> tuple[TrainingRows, tuple]:
    points, vectors = _one_hot(spark, sf_dir)
    rows = TrainingRows(points, vectors, S)
    return rows, rows.modes([Search(np.ones(S), NEWTON_RIDGE)], tol=1e-10)[0]


def q_newton_mode(spark, sf_dir):
    """Latent values of all training rows, by Newton steps of which only sums leave the tasks."""
    rows, (_, search, _) = _newton(spark, sf_dir)
    return rows.latent(search).select("row_id", _six(F.col("f"), "f"))


def q_newton_evidence(spark, sf_dir):
    rows, (evidence, _, _) = _newton(spark, sf_dir)
    rows.release()
    return spark.createDataFrame([(round(evidence, 4),)], "evidence double")


def q_gp_mean_blocks(spark, sf_dir):
    """The posterior mean given all training rows, under a kernel of one block for each anchor and a noise; by sums over the rows, of whom none reach the driver."""
    points, vectors = _one_hot(spark, sf_dir)
    own = vectors.select("row_id", F.transform(F.lit(list(range(S))), lambda a: (a == F.col("own")).cast("double")).alias("v"))
    sums = fits.moments(points.withColumn("y", F.col("x0")), Spectrum(np.ones(S), own), lambda: ())
    mean = gp.regression_posterior(sums, np.ones(S), TIME, 0.5, 0.0).mean
    return fits.project(own, "y_pred double", lambda _, v: [(v @ mean)[:, 0]]).select("row_id", _six(F.col("y_pred"), "y_pred"))


def q_split(spark, sf_dir):
    points = document_points(spark, sf_dir)
    return points.groupBy("is_train").agg(F.count("*").alias("n"), F.count("y").alias("labelled"))


def q_text_features(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"words": F.expr(WORDS), "letters": F.expr(LETTERS)})
    names = ("log_chars", "variety", "alpha", "upper", "word_length")
    return docs.select("doc_id", *[_six(F.expr(f), n) for f, n in zip(TEXT_FEATURES, names, strict=True)])


# --- rows only: eigenvectors, optimisers, samplers ---------------------------------------------------


def _docs(spark, sf_dir, y: str | None = None) -> DataFrame:
    points = document_points(spark, sf_dir)
    return points.withColumn("y", F.expr(y)) if y else points


def _languages(spark, sf_dir) -> DataFrame:
    """Documents with their language's number as the label, by its place among all languages."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("lang", F.lit("")).alias("lang"))
    number = docs.select("lang").distinct().select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).cast("double").alias("y"))  # a row per language
    return document_points(spark, sf_dir).drop("y").join(docs.join(number, "lang").select("row_id", "y"), "row_id").persist()


def q_subsample_kmeans(spark, sf_dir):
    """Per coordinate the anchors' mean by cluster size, which is the points' mean where every anchor is the mean of its points."""
    anchors = subsample(embedding_points(spark, sf_dir), S, "kmeans").frame(spark)
    each = anchors.select("cluster_size", F.posexplode("u").alias("k", "v"))
    total = each.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("anchors"), F.sum("cluster_size").alias("points"), (F.sum(F.col("v") * F.col("cluster_size")) / F.sum("cluster_size")).alias("center"))
    return total.select("k", "anchors", "points", _six(F.col("center"), "center"))


def q_subsample_minibatch(spark, sf_dir):
    """The number of anchors and of points, and coordinates of anchors outside the points' range, which no mean can leave."""
    points = embedding_points(spark, sf_dir)
    u = subsample(points, S, "minibatchkmeans").frame(spark).select("anchor_id", "cluster_size", F.posexplode("u").alias("k", "v"))
    bounds = points.select(F.posexplode("x").alias("c", "x")).groupBy("c").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    seen = u.join(F.broadcast(bounds), F.col("k") == F.col("c"))  # a row for each coordinate
    outside = F.sum(((F.col("v") < F.col("low") - 1e-9) | (F.col("v") > F.col("high") + 1e-9)).cast("long"))
    return seen.agg(F.count_distinct("anchor_id").alias("anchors"), F.sum(F.when(F.col("k") == 0, F.col("cluster_size"))).alias("points"), outside.alias("outside"))


def _weights(z: DataFrame, digits: int = 4) -> DataFrame:
    each = z.select("row_id", F.explode(F.arrays_zip("idx", "w")).alias("e"))
    return each.select("row_id", F.col("e.idx").cast("long").alias("anchor_id"), (F.round("e.w", digits) + F.lit(0.0)).alias("w"))


def q_lae(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    return _weights(lae_weights(points, _anchors(points).u, R, **EXACT))


def q_cross_similarity_lae(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    return _weights(cross_similarity_lae(points, _anchors(points), R, "cluster-normalized", **EXACT))


def _moments(vectors: DataFrame, values: np.ndarray) -> DataFrame:
    """Sums over all eigenpairs of value * v^2 and value^2 * v^2, which no sign or rotation of the vectors changes."""
    out = fits.project(vectors, "m1 double, m2 double", lambda _, v: [v**2 @ values, v**2 @ values**2])
    return out.select("row_id", F.round("m1", 4).alias("m1"), F.round("m2", 4).alias("m2"))


def q_spectrum(spark, sf_dir):
    anchors, z = _normalized(spark, sf_dir, "cluster-normalized")
    spec = spectrum_from_weights(z, len(anchors.u))
    return _moments(spec.vectors, spec.values)


def q_eigenmap(spark, sf_dir):
    """Of all of the eigenmap's coordinates, as ``q_spectrum``; its eigenvalues are one less the root of the similarity's."""
    laplacian, vectors = fits.lae_eigenmap(embedding_points(spark, sf_dir), S, 1, S - 1, "random")
    return _moments(vectors, (1 - laplacian) ** 2)


def q_covariance(spark, sf_dir):
    """The heat kernel of all points, one anchor each, for which it has a closed form."""
    models = fits.ModelSpec(subsample="random", gl="rw", root=False)
    h = fits.heat_kernel_covariance(embedding_points(spark, sf_dir), S, 1, TIME, models=models)
    return h.select("i", "j", _cut(F.col("h"), 4, "h"))


def _two(spark, sf_dir) -> DataFrame:
    """Points whose two eigenvector entries are their first two coordinates, and whose target is the third."""
    return embedding_points(spark, sf_dir).select("row_id", F.slice("x", 1, 2).alias("v"), F.col("x")[2].alias("y"))


def _two_moments(rows: DataFrame) -> gp.Moments:
    v1, v2, y = F.col("v")[0], F.col("v")[1], F.col("y")
    r = rows.agg(F.sum(v1 * v1), F.sum(v1 * v2), F.sum(v2 * v2), F.sum(v1 * y), F.sum(v2 * y), F.sum(y * y), F.count("*")).first()
    return gp.Moments(np.array([[r[0], r[1]], [r[1], r[2]]]), np.array([[r[3]], [r[4]]]), r[5], r[6])


def q_regression_evidence(spark, sf_dir):
    value, grad = gp.regression_nmll(_two_moments(_two(spark, sf_dir)), PAIR, TIME, NOISE, 0.0)
    return spark.createDataFrame([(float(round(value, 4)), float(round(grad[1], 4)))], "nmll double, by_noise double")


def q_regression_posterior(spark, sf_dir):
    rows = _two(spark, sf_dir)
    fit = gp.regression_posterior(_two_moments(rows), PAIR, TIME, NOISE, 0.0)
    out = fits.project(rows, "mean double, var double", lambda _, v: [(v @ fit.mean)[:, 0], fits.quadratic(v, fit.spread) + fit.floor])
    return out.select("row_id", _six(F.col("mean"), "mean"), _six(F.col("var"), "var"))


def _classes(spark, sf_dir) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Variances and targets by label: the label and one more, and whether it is odd."""
    labels = [r["label"] for r in embedding_points(spark, sf_dir).select("label").distinct().orderBy("label").collect()]
    return np.array(labels, float) + 1, np.array(labels) % 2.0, labels


def q_laplace_evidence(spark, sf_dir):
    c, y, _ = _classes(spark, sf_dir)
    return spark.createDataFrame([(round(gp.marginal_log_likelihood_logit(np.diag(c), y, tol=1e-12), 6),)], "evidence double")


def q_posterior_classification(spark, sf_dir):
    c, y, labels = _classes(spark, sf_dir)
    rows = embedding_points(spark, sf_dir).select("row_id", F.col("x").alias("v"))
    m = len(labels)
    out = fits.project(rows, "mean double, var double", lambda _, v: list(gp.posterior_classification(np.diag(c), v[:, :m], np.ones(len(v)), y, tol=1e-12)))
    return out.select("row_id", _six(F.col("mean"), "mean"), _six(F.col("var"), "var"))


def q_fit_lae_regression(spark, sf_dir):
    return fits.fit_lae_regression_gp(_docs(spark, sf_dir, "x[4]"), 60, R, 20).predictions


def q_fit_rbf_regression(spark, sf_dir):
    return fits.fit_rbf_regression(_docs(spark, sf_dir, "x[4]"), 60)[1]


def q_fit_se_regression(spark, sf_dir):
    return fits.fit_se_regression_gp(_docs(spark, sf_dir, "x[4]"), 60, R, 20).predictions


def q_fit_nystrom_regression(spark, sf_dir):
    return fits.fit_nystrom_regression_gp(_docs(spark, sf_dir, "x[4]"), 60, 20).predictions


def q_fit_gl_regression(spark, sf_dir):
    return fits.fit_gl_regression_gp(_docs(spark, sf_dir, "x[4]"), 20).predictions


def q_fit_lae_logit(spark, sf_dir):
    return document_quality(spark, sf_dir)


def q_fit_se_logit(spark, sf_dir):
    return fits.fit_se_logit_gp(_docs(spark, sf_dir), 60, R, 20).predictions


def q_fit_nystrom_logit(spark, sf_dir):
    return fits.fit_nystrom_logit_gp(_docs(spark, sf_dir), 60, 20).predictions


def q_fit_gl_logit(spark, sf_dir):
    return fits.fit_gl_logit_gp(_docs(spark, sf_dir), 20).predictions


def q_fit_lae_multinomial(spark, sf_dir):
    return fits.fit_lae_logit_mult_gp(_languages(spark, sf_dir), 60, R, 20).predictions


def q_fit_se_multinomial(spark, sf_dir):
    return fits.fit_se_logit_mult_gp(_languages(spark, sf_dir), 60, R, 20).predictions


def q_fit_nystrom_multinomial(spark, sf_dir):
    return fits.fit_nystrom_logit_mult_gp(_languages(spark, sf_dir), 60, 20).predictions


def q_fit_gl_multinomial(spark, sf_dir):
    return fits.fit_gl_logit_mult_gp(_languages(spark, sf_dir), 20).predictions


def q_nll_binary(spark, sf_dir):
    rows = embedding_points(spark, sf_dir).select("row_id", (3 * F.col("x")[0]).alias("mean"), (1 + F.abs(F.col("x")[1])).alias("var"), (F.col("label") % 2).cast("double").alias("y"))
    return metrics.negative_log_likelihood(rows, "binary", samples=0).select(_six(F.col("nll"), "nll"))


def q_nll_multinomial(spark, sf_dir):
    rows = embedding_points(spark, sf_dir).select("row_id", F.slice("x", 1, 10).alias("mean"), F.transform(F.slice("x", 11, 10), lambda v: 1 + F.abs(v)).alias("var"), F.col("label").alias("y"))
    return metrics.negative_log_likelihood(rows, "multinomial", samples=0).select((F.round("nll", 5) + F.lit(0.0)).alias("nll"))


def q_nll_of_fit(spark, sf_dir):
    points = _docs(spark, sf_dir)
    out = fits.fit_lae_logit_gp(points, 60, R, 20).predictions
    return metrics.negative_log_likelihood(out.join(points.select("row_id", "y"), "row_id").where("not is_train and y is not null"), "binary")


# --- whole fits by one eigenpair, the constant: their results have closed forms ----------------------


def _halves(spark, sf_dir, y: str) -> DataFrame:
    """All vectors, whose graphs hang together; those of even id train, with ``y`` as the target."""
    return embedding_points(spark, sf_dir).withColumn("is_train", F.expr("row_id % 2 = 0")).withColumn("y", F.expr(y).cast("double")).persist()


def _constant_regression(method: str, **size):
    def query(spark, sf_dir):
        out = fits.fit_regression(_halves(spark, sf_dir, "x[0]"), method, k=1, a2s=None if method == "lae" else (1.0,), **size).predictions
        return out.select("row_id", "is_train", (F.round("y_pred", 4) + F.lit(0.0)).alias("y_pred"), F.round("var", 4).alias("var"))

    return query


def _four(column, name: str):
    return (F.round(column, 4) + F.lit(0.0)).alias(name)


def _constant_logit(method: str, **size):
    def query(spark, sf_dir):
        out = fits.fit_logit(_halves(spark, sf_dir, "label >= 3"), method, k=1, a2s=None if method == "lae" else (1.0,), **size).predictions
        return out.select("row_id", "is_train", "y_pred", ((F.col("pi") > 0.5) == (F.col("mean") > 0)).alias("agree"), _four("mean", "mean"), _four("var", "var"))

    return query


def _constant_multinomial(method: str, **size):
    def query(spark, sf_dir):
        out = fits.fit_multinomial(_halves(spark, sf_dir, "least(label, 2)"), method, k=1, a2s=None if method == "lae" else (1.0,), **size).predictions
        each = [_four(F.col(c)[j], f"{c}_{j}") for c in ("mean", "var") for j in range(3)]
        return out.select("row_id", "is_train", F.col("y_pred").cast("long").alias("y_pred"), F.size("pi").cast("long").alias("classes"), *each)

    return query


def _cluster(method: str, task: str):
    """A whole fit of points that weigh one anchor each: the kernel is a block for each anchor, so that each block's posterior has a form of its own."""
    options = {"s": S, "r": 1, "a2s": None if method == "lae" else (1.0,), "models": fits.ModelSpec(subsample="random", kernel=method, gl="rw")}

    def labelled(spark, sf_dir):
        """Labels by signs of the first two coordinates of a point's anchor; of every 97th point the next class."""
        points = embedding_points(spark, sf_dir)
        u = subsample(points, S, "random").u
        of_anchor = np.where(u[:, 0] > 0, 0, np.where(u[:, 1] > 0, 1, 2)) if task == "multinomial" else (u[:, 0] > 0).astype(int)
        own = nearest_anchors(points, u, 1).select("row_id", F.element_at(F.lit(of_anchor.tolist()), F.col("idx")[0] + 1).alias("own"))
        label = F.pmod(F.col("own") + (F.col("row_id") % 97 == 0).cast("int"), F.lit(3 if task == "multinomial" else 2))
        return points.join(own, "row_id").select("row_id", "x", (F.col("row_id") % 2 == 0).alias("is_train"), label.cast("double").alias("y"))

    def query(spark, sf_dir):
        if task == "regression":
            out = fits.fit_regression(_halves(spark, sf_dir, "x[0]"), method, **options).predictions
            return out.select("row_id", "is_train", _four("y_pred", "y_pred"), _four("var", "var"))
        if task == "logit":
            out = fits.fit_logit(labelled(spark, sf_dir), method, **options).predictions
            return out.select("row_id", "is_train", _four("mean", "mean"), _four("var", "var"))
        out = fits.fit_multinomial(labelled(spark, sf_dir), method, **options).predictions
        long = out.select("row_id", "is_train", F.posexplode(F.arrays_zip("mean", "var")).alias("class", "m"))
        return long.select("row_id", "is_train", F.col("class").cast("long").alias("class"), _four("m.mean", "mean"), _four("m.var", "var"))

    return query


CLUSTER = {f"q_cluster_{method}_{task}": _cluster(method, task) for method in ("lae", "se") for task in ("regression", "logit", "multinomial")}

CONSTANT = {
    f"q_constant_{method}_{task}": make(method, **({} if method == "gl" else {"s": S}))
    for task, make in (("regression", _constant_regression), ("logit", _constant_logit), ("multinomial", _constant_multinomial))
    for method in ("lae", "se", "nystrom", "gl")
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")} | CONSTANT | CLUSTER

# --- SQL --------------------------------------------------------------------------------------------

_BASE = f"""
WITH e AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
pick AS (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 2654435761) % 1000003, vec_id) - 1 AS anchor_id FROM embeddings
  ORDER BY anchor_id LIMIT {S}),
u AS (SELECT anchor_id, k, v FROM e JOIN pick ON row_id = vec_id),
d AS (SELECT e.row_id, u.anchor_id, sum((e.v - u.v) * (e.v - u.v)) AS d2 FROM e JOIN u USING (k) GROUP BY ALL),
nn AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, anchor_id) AS rank FROM d)
"""
_KNN = f"{_BASE}, near AS (SELECT * FROM nn WHERE rank <= {R})"
_GRID = f"{_KNN}, z AS (SELECT row_id, anchor_id, exp(-d2 / ({A2} * (SELECT avg(d2) FROM near))) AS w FROM near)"
_COLS = f"{_GRID}, c AS (SELECT anchor_id, sum(w) AS t FROM z GROUP BY 1), n1 AS (SELECT anchor_id, count(*) AS size FROM nn WHERE rank = 1 GROUP BY 1)"
_ROWS = "SELECT row_id, anchor_id, round(w / (sum(w) OVER (PARTITION BY row_id) + 1e-9), 6) + 0.0 AS w FROM y"



def _random_anchors() -> str:
    """CTEs up to pick (vec_id, anchor_id): the first rows by XXH64 of (row_id, 0), seed 42, as a signed number."""
    whole = 1 << 64
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261  # fixed values of XXH64
    n = lambda v: f"{v}::UHUGEINT"
    times = lambda a, b: f"({a} * {n(b)}) % {n(whole)}"
    turned = lambda a, r: f"({a} * {n(1 << r)}) % {n(whole)} + {a} // {n(1 << 64 - r)}"
    mixed = lambda a, b: f"xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT))::UHUGEINT"
    finish = [lambda h: mixed(h, f"{h} // {n(1 << 33)}"), lambda h: times(h, p2), lambda h: mixed(h, f"{h} // {n(1 << 29)}"), lambda h: times(h, p3), lambda h: mixed(h, f"{h} // {n(1 << 32)}")]
    steps = [
        lambda h: times("vec_id::UHUGEINT", p2), lambda h: turned(h, 31), lambda h: times(h, p1), lambda h: mixed(h, n(42 + p5 + 8)), lambda h: turned(h, 27),
        lambda h: f"({times(h, p1)} + {n(p4)}) % {n(whole)}", *finish,
        lambda h: f"({h} + {n(p5 + 4)}) % {n(whole)}", lambda h: turned(h, 23), lambda h: f"({times(h, p2)} + {n(p3)}) % {n(whole)}", *finish,
    ]
    out = ["h0 AS (SELECT vec_id, 0::UHUGEINT AS h FROM embeddings)"]
    out += [f"h{i + 1} AS (SELECT vec_id, {step('h')} AS h FROM h{i})" for i, step in enumerate(steps)]
    order = f"(h + {n(1 << 63)}) % {n(whole)}"
    return ", ".join([*out, f"pick AS (SELECT vec_id, row_number() OVER (ORDER BY {order}, vec_id) - 1 AS anchor_id FROM h{len(steps)} ORDER BY anchor_id LIMIT {S})"])


_HASHED = f"""
WITH e AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), {_random_anchors()},
u AS (SELECT anchor_id, k, v FROM e JOIN pick ON row_id = vec_id),
d AS (SELECT e.row_id, u.anchor_id, sum((e.v - u.v) * (e.v - u.v)) AS d2 FROM e JOIN u USING (k) GROUP BY ALL),
own AS (SELECT row_id, anchor_id FROM d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, anchor_id) = 1),
size AS (SELECT anchor_id, count(*) AS m FROM own GROUP BY 1)"""
#: Weights of three anchors: of the points, edges and inside of their triangle, the feasible place of least distance.
_LAE = f"""{_KNN},
g AS (SELECT e.row_id, max(near.anchor_id) FILTER (rank = 1) AS a, max(near.anchor_id) FILTER (rank = 2) AS b, max(near.anchor_id) FILTER (rank = 3) AS c FROM near JOIN (SELECT DISTINCT row_id FROM e) e USING (row_id) GROUP BY 1),
q AS (SELECT row_id, a, b, c, sum((p1.v - e.v) ** 2) AS g11, sum((p2.v - e.v) ** 2) AS g22, sum((p3.v - e.v) ** 2) AS g33,
    sum((p1.v - e.v) * (p2.v - e.v)) AS g12, sum((p1.v - e.v) * (p3.v - e.v)) AS g13, sum((p2.v - e.v) * (p3.v - e.v)) AS g23
  FROM g JOIN e USING (row_id) JOIN u p1 ON p1.anchor_id = a AND p1.k = e.k JOIN u p2 ON p2.anchor_id = b AND p2.k = e.k JOIN u p3 ON p3.anchor_id = c AND p3.k = e.k GROUP BY ALL),
t AS (SELECT *, g22 * g33 - g23 * g23 - g12 * (g33 - g23) + g13 * (g23 - g22) AS t1, g11 * g33 - g13 * g13 - g12 * (g33 - g13) + g23 * (g13 - g11) AS t2,
    g11 * g22 - g12 * g12 - g13 * (g22 - g12) + g23 * (g12 - g11) AS t3 FROM q),
w AS (SELECT row_id, a, b, c, unnest([
    {{'x': 1.0::DOUBLE, 'y': 0.0::DOUBLE, 'z': 0.0::DOUBLE}}, {{'x': 0.0, 'y': 1.0, 'z': 0.0}}, {{'x': 0.0, 'y': 0.0, 'z': 1.0}},
    {{'x': (g22 - g12) / nullif(g11 + g22 - 2 * g12, 0), 'y': (g11 - g12) / nullif(g11 + g22 - 2 * g12, 0), 'z': 0.0}},
    {{'x': (g33 - g13) / nullif(g11 + g33 - 2 * g13, 0), 'y': 0.0, 'z': (g11 - g13) / nullif(g11 + g33 - 2 * g13, 0)}},
    {{'x': 0.0, 'y': (g33 - g23) / nullif(g22 + g33 - 2 * g23, 0), 'z': (g22 - g23) / nullif(g22 + g33 - 2 * g23, 0)}},
    {{'x': t1 / nullif(t1 + t2 + t3, 0), 'y': t2 / nullif(t1 + t2 + t3, 0), 'z': t3 / nullif(t1 + t2 + t3, 0)}}], recursive := false) AS p, g11, g22, g33, g12, g13, g23 FROM t),
best AS (SELECT row_id, a, b, c, arg_min(p, p.x * p.x * g11 + p.y * p.y * g22 + p.z * p.z * g33 + 2 * (p.x * p.y * g12 + p.x * p.z * g13 + p.y * p.z * g23)) AS p
  FROM w WHERE p.x >= 0 AND p.y >= 0 AND p.z >= 0 GROUP BY ALL),
z AS (SELECT row_id, a AS anchor_id, p.x AS w FROM best UNION ALL SELECT row_id, b, p.y FROM best UNION ALL SELECT row_id, c, p.z FROM best)"""
#: Sums over all eigenpairs from the weights y alone: entries of n AA' and n (AA')^2 for A = Z diag(colsum)^-1/2.
_MOMENTS = """, dd AS (SELECT anchor_id, sum(w) + 1e-9 AS t FROM y GROUP BY 1),
a AS (SELECT row_id, anchor_id, w / sqrt(t) AS w FROM y JOIN dd USING (anchor_id)),
gg AS (SELECT p.anchor_id AS i, q.anchor_id AS j, sum(p.w * q.w) AS g FROM a p JOIN a q USING (row_id) GROUP BY ALL),
m1 AS (SELECT row_id, sum(w * w) AS m FROM a GROUP BY 1),
m2 AS (SELECT p.row_id, sum(p.w * g * q.w) AS m FROM a p JOIN a q USING (row_id) JOIN gg ON i = p.anchor_id AND j = q.anchor_id GROUP BY 1)
SELECT row_id, round(m1.m * n, 4) AS m1, round(m2.m * n, 4) AS m2 FROM m1 JOIN m2 USING (row_id), (SELECT count(*) AS n FROM embeddings)"""
#: The likelihood of a positive target: the logistic function under a normal density, summed on a fine grid.
_LIKELY = "list_sum(list_transform(range(-900, 901), lambda i: exp(-i * i / 20000.0) / (1 + exp(-(m + sqrt(s) * i / 100.0))))) / list_sum(list_transform(range(-900, 901), lambda i: exp(-i * i / 20000.0)))"
_TWO = f"""WITH r AS (SELECT vec_id AS row_id, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS q, embedding[3]::DOUBLE AS y FROM embeddings),
m AS (SELECT sum(p * p) AS g11, sum(p * q) AS g12, sum(q * q) AS g22, sum(p * y) AS b1, sum(q * y) AS b2, sum(y * y) AS yy, count(*) AS n, 1.0::DOUBLE AS l1, exp(-{TIME} * 0.5) AS l2, {NOISE}::DOUBLE AS v FROM r),
i AS (SELECT *, v / l1 + g11 AS a, g12 AS b, v / l2 + g22 AS d FROM m),
w AS (SELECT *, (d * b1 - b * b2) / (a * d - b * b) AS w1, (a * b2 - b * b1) / (a * d - b * b) AS w2 FROM i)"""
_MODES = """WITH RECURSIVE l AS (SELECT DISTINCT label::BIGINT AS label, label + 1.0::DOUBLE AS c, (label % 2)::DOUBLE AS y FROM embeddings),
s AS (SELECT label, c, y, 0.0::DOUBLE AS f, 0 AS n FROM l UNION ALL
  SELECT label, c, y, c * (w * f + y - p) / (1 + c * w), n + 1 FROM (SELECT *, 1 / (1 + exp(-f)) AS p, 1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) AS w FROM s) t WHERE n < 40),
o AS (SELECT label, c, y, f, 1 / (1 + exp(-f)) AS p, 1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) AS w FROM s WHERE n = 40)"""
#: One noise v: the evidence of a constant under unit prior variance and the noise's prior, at its stationary point, by bisection in log v.
_CONSTANT_REGRESSION = """WITH RECURSIVE pts AS (SELECT vec_id AS row_id, vec_id % 2 = 0 AS is_train, embedding[1]::DOUBLE AS y FROM embeddings),
m AS (SELECT sum(y) AS sy, sum(y * y) AS yy, count(*)::DOUBLE AS n FROM pts WHERE is_train),
b AS (SELECT ln(1.1e-4) AS lo, ln(1e6) AS hi, 0 AS step UNION ALL
  SELECT CASE WHEN slope > 0 THEN lo ELSE ln(v) END, CASE WHEN slope > 0 THEN ln(v) ELSE hi END, step + 1 FROM (
    SELECT lo, hi, step, v, -0.5 * (yy - sy * sy / (v + n)) / v ** 2 + 0.5 * sy * sy / (v + n) ** 2 / v + 0.5 / (v + n) + 0.5 * (n - 1) / v + 1.1 / v - 1e-3 / v ** 2 AS slope
    FROM (SELECT *, exp((lo + hi) / 2) AS v FROM b) z, m) t WHERE step < 60),
f AS (SELECT exp((lo + hi) / 2) AS v FROM b WHERE step = 60)
SELECT row_id, is_train, round(sy / (n + v), 4) + 0.0 AS y_pred, round(v / (n + v) + v, 4) AS var FROM pts, m, f"""


#: The ridge of classification; one-versus-rest posteriors go without it.
RIDGE = 0.001


def _modes_sql(counts: str, sigma: float) -> str:
    """CTEs up to ``mode`` (g, w, var) from ``counts`` (g, c, n1, n0): the Laplace posterior of n1 positive and n0 negative rows that share one
    latent value w of prior variance c and have ``sigma`` each of their own; its stationary point by bisection in w."""
    def latent(sign: int) -> str:
        out = "w"
        for _ in range(4 if sigma else 0):  # each step leaves a 4000th of the error
            out = f"(w + {sigma} * ({sign} - 1 / (1 + exp(-greatest(least({out}, 700), -700)))))"
        return f"1 / (1 + exp(-greatest(least({out}, 700), -700)))"

    share = lambda p: f"({p} * (1 - {p}) / (1 + {sigma} * {p} * (1 - {p})))"
    return f"""b AS (SELECT g, c::DOUBLE AS c, n1::DOUBLE AS n1, n0::DOUBLE AS n0, -c * n0 - 1.0::DOUBLE AS lo, c * n1 + 1.0::DOUBLE AS hi, 0 AS step FROM {counts} UNION ALL
  SELECT g, c, n1, n0, CASE WHEN c * (n1 * (1 - p1) - n0 * p0) > w THEN w ELSE lo END, CASE WHEN c * (n1 * (1 - p1) - n0 * p0) > w THEN hi ELSE w END, step + 1
  FROM (SELECT *, {latent(1)} AS p1, {latent(0)} AS p0 FROM (SELECT *, (lo + hi) / 2 AS w FROM b)) WHERE step < 80),
mode AS (SELECT g, w, c / (1 + c * (n1 * {share("p1")} + n0 * {share("p0")})) + {RIDGE} AS var
  FROM (SELECT *, {latent(1)} AS p1, {latent(0)} AS p0 FROM (SELECT *, (lo + hi) / 2 AS w FROM b WHERE step = 80)))"""


_HALVES = "pts AS (SELECT vec_id AS row_id, vec_id % 2 = 0 AS is_train, embedding[1]::DOUBLE AS x0, (label >= 3)::INT AS two, least(label, 2)::BIGINT AS three FROM embeddings)"
_CONSTANT_LOGIT = f"""WITH RECURSIVE {_HALVES},
cnt AS (SELECT 0 AS g, 1 AS c, sum(two) AS n1, sum(1 - two) AS n0 FROM pts WHERE is_train), {_modes_sql("cnt", RIDGE)}
SELECT row_id, is_train, (SELECT CASE WHEN n1 > n0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM cnt) AS y_pred, true AS agree, round(w, 4) + 0.0 AS mean, round(var, 4) + 0.0 AS var FROM pts, mode"""
_CONSTANT_MULTINOMIAL = f"""WITH RECURSIVE {_HALVES}, k AS (SELECT three AS y, count(*) AS m FROM pts WHERE is_train GROUP BY 1),
cnt AS (SELECT y AS g, 1 AS c, m AS n1, (SELECT sum(m) FROM k) - m AS n0 FROM k), {_modes_sql("cnt", 0)},
wide AS (SELECT {", ".join(f"max(round({c}, 4) + 0.0) FILTER (g = {j}) AS {n}_{j}" for c, n in (("w", "mean"), ("var", "var")) for j in range(3))} FROM mode)
SELECT row_id, is_train, (SELECT y FROM k ORDER BY m DESC, y LIMIT 1) AS y_pred, (SELECT max(y) + 1 FROM k) AS classes, wide.* FROM pts, wide"""
_ONE_ANCHOR = f"""{_HASHED.replace("WITH", "WITH RECURSIVE", 1)}, {_HALVES},
blk AS (SELECT anchor_id, (SELECT count(*) FROM embeddings)::DOUBLE / m AS c FROM size),
sgn AS (SELECT anchor_id, max(v) FILTER (k = 0) > 0 AS s0, max(v) FILTER (k = 1) > 0 AS s1 FROM u GROUP BY 1),
o AS (SELECT row_id, is_train, x0, anchor_id, (s0::INT + (row_id % 97 = 0)::INT) % 2 AS two, (CASE WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END + (row_id % 97 = 0)::INT) % 3 AS three
  FROM pts JOIN own USING (row_id) JOIN sgn USING (anchor_id))"""
_NEWTON = f"""cnt AS (SELECT anchor_id AS g, c, coalesce(sum(two) FILTER (is_train), 0) AS n1, coalesce(sum(1 - two) FILTER (is_train), 0) AS n0 FROM blk JOIN o USING (anchor_id) GROUP BY ALL),
start AS (SELECT g, c::DOUBLE AS c, n1::DOUBLE AS n1, n0::DOUBLE AS n0, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS f0, 0 AS step FROM cnt),
newton AS (SELECT * FROM start UNION ALL SELECT g, c, n1, n0, c * shift + {NEWTON_RIDGE} * (b1 - w1 * c * shift) / (1 + {NEWTON_RIDGE} * w1), c * shift + {NEWTON_RIDGE} * (b0 - w0 * c * shift) / (1 + {NEWTON_RIDGE} * w0), step + 1
  FROM (SELECT *, (n1 * b1 / (1 + {NEWTON_RIDGE} * w1) + n0 * b0 / (1 + {NEWTON_RIDGE} * w0)) / (1 + c * (n1 * w1 / (1 + {NEWTON_RIDGE} * w1) + n0 * w0 / (1 + {NEWTON_RIDGE} * w0))) AS shift
    FROM (SELECT *, w1 * f1 + 1 - p1 AS b1, w0 * f0 - p0 AS b0 FROM (SELECT *, p1 * (1 - p1) AS w1, p0 * (1 - p0) AS w0 FROM (SELECT *, 1 / (1 + exp(-f1)) AS p1, 1 / (1 + exp(-f0)) AS p0 FROM newton)))) WHERE step < 40),
done AS (SELECT *, n1 * p1 * (1 - p1) / (1 + {NEWTON_RIDGE} * p1 * (1 - p1)) + n0 * p0 * (1 - p0) / (1 + {NEWTON_RIDGE} * p0 * (1 - p0)) AS shared
  FROM (SELECT *, 1 / (1 + exp(-f1)) AS p1, 1 / (1 + exp(-f0)) AS p0 FROM newton WHERE step = 40))"""
_CLUSTER_LOGIT = f"""{_ONE_ANCHOR},
cnt AS (SELECT anchor_id AS g, c, coalesce(sum(two) FILTER (is_train), 0) AS n1, coalesce(sum(1 - two) FILTER (is_train), 0) AS n0 FROM blk JOIN o USING (anchor_id) GROUP BY ALL), {_modes_sql("cnt", RIDGE)}
SELECT row_id, is_train, round(w, 4) + 0.0 AS mean, round(var, 4) + 0.0 AS var FROM o JOIN mode ON anchor_id = g"""
_CLUSTER_MULTINOMIAL = f"""{_ONE_ANCHOR},
cnt AS (SELECT anchor_id * 3 + j.range AS g, c, count(*) FILTER (is_train AND three = j.range) AS n1, count(*) FILTER (is_train AND three <> j.range) AS n0
  FROM blk JOIN o USING (anchor_id), range(3) j GROUP BY anchor_id, j.range, c), {_modes_sql("cnt", 0)}
SELECT row_id, is_train, j.range AS class, round(w, 4) + 0.0 AS mean, round(var, 4) + 0.0 AS var FROM o, range(3) j JOIN mode ON o.anchor_id * 3 + j.range = g"""
_CLUSTER_REGRESSION = f"""{_ONE_ANCHOR},
m AS (SELECT anchor_id, c, count(*) FILTER (is_train)::DOUBLE AS n, coalesce(sum(x0) FILTER (is_train), 0) AS sy, coalesce(sum(x0 * x0) FILTER (is_train), 0) AS yy FROM blk JOIN o USING (anchor_id) GROUP BY ALL),
l AS (SELECT list({{'c': c, 'n': n, 'sy': sy, 'yy': yy}}) AS l FROM m),
b AS (SELECT ln(1.1e-4) AS lo, ln(1e6) AS hi, 0 AS step UNION ALL
  SELECT CASE WHEN slope > 0 THEN lo ELSE ln(v) END, CASE WHEN slope > 0 THEN ln(v) ELSE hi END, step + 1 FROM (
    SELECT lo, hi, step, v, 1.1 / v - 1e-3 / v ** 2 + list_sum(list_transform(l, lambda a: 0.5 * (-a.yy / v ** 2 + a.c * a.sy ** 2 * (2 * v + a.c * a.n) / (v * (v + a.c * a.n)) ** 2 + (a.n - 1) / v + 1 / (v + a.c * a.n)))) AS slope
    FROM (SELECT *, exp((lo + hi) / 2) AS v FROM b) z, l) t WHERE step < 60),
f AS (SELECT exp((lo + hi) / 2) AS v FROM b WHERE step = 60)
SELECT row_id, is_train, round(c * sy / (v + c * n), 4) + 0.0 AS y_pred, round(c * v / (v + c * n) + v, 4) + 0.0 AS var FROM o JOIN m USING (anchor_id), f"""

ORACLE_SQL = {
    **{f"q_constant_{method}_{task}": sql for task, sql in (("regression", _CONSTANT_REGRESSION), ("logit", _CONSTANT_LOGIT), ("multinomial", _CONSTANT_MULTINOMIAL)) for method in ("lae", "se", "nystrom", "gl")},
    **{f"q_cluster_{method}_{task}": sql for task, sql in (("regression", _CLUSTER_REGRESSION), ("logit", _CLUSTER_LOGIT), ("multinomial", _CLUSTER_MULTINOMIAL)) for method in ("lae", "se")},
    "q_lae": f"{_LAE} SELECT row_id, anchor_id, round(w, 4) + 0.0 AS w FROM z",
    "q_cross_similarity_lae": f"""{_LAE}, cc AS (SELECT anchor_id, sum(w) AS t FROM z GROUP BY 1), n1 AS (SELECT anchor_id, count(*) AS size FROM nn WHERE rank = 1 GROUP BY 1),
y AS (SELECT row_id, anchor_id, w / (t + 1e-9) * coalesce(size, 0) AS w FROM z JOIN cc USING (anchor_id) LEFT JOIN n1 USING (anchor_id))
SELECT row_id, anchor_id, round(w / (sum(w) OVER (PARTITION BY row_id) + 1e-9), 4) + 0.0 AS w FROM y""",
    "q_spectrum": f"""{_COLS}, yy AS (SELECT row_id, anchor_id, w / (t + 1e-9) * coalesce(size, 0) AS w FROM z JOIN c USING (anchor_id) LEFT JOIN n1 USING (anchor_id)),
y AS (SELECT row_id, anchor_id, w / (sum(w) OVER (PARTITION BY row_id) + 1e-9) AS w FROM yy) {_MOMENTS}""",
    "q_eigenmap": f"{_HASHED}, y AS (SELECT row_id, anchor_id, 1.0::DOUBLE AS w FROM own) {_MOMENTS}",
    "q_covariance": f"""{_HASHED} SELECT a.row_id AS i, b.row_id AS j, round(CASE WHEN a.anchor_id = b.anchor_id THEN n / m ELSE 0 END, 4) + 0.0 AS h
FROM own a, own b, (SELECT count(*)::DOUBLE AS n FROM embeddings) JOIN size ON a.anchor_id = size.anchor_id""",
    "q_subsample_kmeans": f"{_BASE} SELECT k::BIGINT AS k, {S}::BIGINT AS anchors, count(*) AS points, round(avg(v), 6) + 0.0 AS center FROM e GROUP BY 1",
    "q_subsample_minibatch": f"SELECT {S}::BIGINT AS anchors, count(*) AS points, 0::BIGINT AS outside FROM embeddings",
    "q_nll_binary": f"""WITH r AS (SELECT 3 * embedding[1]::DOUBLE AS m, 1 + abs(embedding[2]::DOUBLE) AS s, label % 2 AS y FROM embeddings), l AS (SELECT y, {_LIKELY} AS pi FROM r)
SELECT round(avg(-ln(CASE WHEN y > 0 THEN pi ELSE 1 - pi END + 1e-2)), 6) + 0.0 AS nll FROM l""",
    "q_nll_multinomial": f"""WITH r AS (SELECT vec_id, embedding[j.range + 1]::DOUBLE AS m, 1 + abs(embedding[j.range + 11]::DOUBLE) AS s, label = j.range AS y FROM embeddings, range(10) j), l AS (SELECT vec_id, y, {_LIKELY} AS pi FROM r)
SELECT round(sum(-ln(CASE WHEN y THEN pi ELSE 1 - pi END + 1e-2)) / count(DISTINCT vec_id), 5) + 0.0 AS nll FROM l""",
    "q_regression_evidence": f"""{_TWO}, z AS (SELECT *, (yy - b1 * w1 - b2 * w2) / v AS quad, l1 * l2 * (a * d - b * b) AS det,
  (yy - 2 * (b1 * w1 + b2 * w2) + w1 * w1 * g11 + 2 * w1 * w2 * g12 + w2 * w2 * g22) / (v * v) AS alpha2, (n - 2) / v + (a / l2 + d / l1) / l1 / l2 * l1 * l2 / (a * d - b * b) AS trace FROM w)
SELECT round(0.5 * quad + 0.5 * ln(det) + 0.5 * (n - 2) * ln(v), 4) AS nmll, round(0.5 * trace - 0.5 * alpha2, 4) AS by_noise FROM z""",
    "q_regression_posterior": f"""{_TWO} SELECT row_id, round(p * w1 + q * w2, 6) + 0.0 AS mean,
  round(v * (d * p * p - 2 * b * p * q + a * q * q) / (a * d - b * b) + v, 6) + 0.0 AS var FROM r, w""",
    "q_laplace_evidence": f"{_MODES} SELECT round(sum(-0.5 * f * f / c + CASE WHEN y > 0 THEN ln(p) ELSE ln(1 - p) END - 0.5 * ln(1 + w * c)), 6) AS evidence FROM o",
    "q_posterior_classification": f"""{_MODES}, j AS (SELECT *, row_number() OVER (ORDER BY label) AS k FROM o)
SELECT vec_id AS row_id, round(sum(embedding[k]::DOUBLE * (y - p)), 6) + 0.0 AS mean, round(1 - sum(embedding[k]::DOUBLE ** 2 * w / (1 + w * c)), 6) + 0.0 AS var FROM embeddings, j GROUP BY 1""",
    "q_random_anchor": f"{_BASE} SELECT vec_id AS row_id, round(sum(v * v), 6) + 0.0 AS norm2 FROM pick JOIN e ON row_id = vec_id GROUP BY 1",
    "q_sqdist": f"{_BASE} SELECT row_id, anchor_id, round(d2, 6) + 0.0 AS d2 FROM d",
    "q_knn": f"{_KNN} SELECT row_id, rank, anchor_id, round(d2, 6) + 0.0 AS d2 FROM near",
    "q_cluster_size": f"{_BASE} SELECT anchor_id, count(nn.row_id) AS cluster_size FROM pick LEFT JOIN (SELECT * FROM nn WHERE rank = 1) nn USING (anchor_id) GROUP BY 1",
    "q_lloyd_step": f"{_BASE} SELECT anchor_id, k, round(avg(v), 6) + 0.0 AS center FROM nn JOIN e USING (row_id) WHERE rank = 1 GROUP BY ALL",
    "q_se_weight": f"{_KNN} SELECT row_id, anchor_id, round(exp(-d2 / {4 * EPSILON**2}), 6) + 0.0 AS w FROM near",
    "q_se_grid_weight": f"{_GRID} SELECT row_id, anchor_id, round(w, 6) + 0.0 AS w FROM z",
    "q_gl_rw": f"{_GRID}, y AS (SELECT * FROM z) {_ROWS}",
    "q_gl_normalized": f"{_COLS}, y AS (SELECT row_id, anchor_id, w / (t + 1e-9) AS w FROM z JOIN c USING (anchor_id)) {_ROWS}",
    "q_gl_cluster": f"{_COLS}, y AS (SELECT row_id, anchor_id, w / (t + 1e-9) * coalesce(size, 0) AS w FROM z JOIN c USING (anchor_id) LEFT JOIN n1 USING (anchor_id)) {_ROWS}",
    "q_gram": f"""{_GRID}, y AS (SELECT row_id, anchor_id, w / (sum(w) OVER (PARTITION BY row_id) + 1e-9) AS w FROM z)
SELECT a.anchor_id AS i, b.anchor_id AS j, round(sum(a.w * b.w), 6) + 0.0 AS g FROM y a JOIN y b USING (row_id) GROUP BY ALL""",
    "q_sym_graph": f"""
WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.id AS i, b.id AS j, greatest(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) * (a.x[k] - b.x[k]))), 0) AS d2 FROM p a, p b),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= {NEAR}),
z AS (SELECT i, j, exp(-d2 / {A2}) AS w FROM k),
s AS (SELECT i, j, sum(w) / 2 AS w FROM (FROM z UNION ALL SELECT j, i, w FROM z) GROUP BY ALL),
g AS (SELECT i, sum(w) + 1e-9 AS t FROM s GROUP BY 1),
a AS (SELECT s.i, s.j, w / p.t / q.t AS w FROM s JOIN g p ON p.i = s.i JOIN g q ON q.i = s.j),
h AS (SELECT i, sum(w) + 1e-9 AS t FROM a GROUP BY 1)
SELECT a.i, a.j, round(w / sqrt(p.t) / sqrt(q.t), 6) + 0.0 AS w FROM a JOIN h p ON p.i = a.i JOIN h q ON q.i = a.j""",
    "q_nystrom_weight": f"""{_BASE}, uu AS (SELECT a.anchor_id AS i, b.anchor_id AS j, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM u a JOIN u b USING (k) GROUP BY ALL),
m AS (SELECT {A2} * avg(d2) AS scale FROM uu),
du AS (SELECT i AS anchor_id, sum(exp(-d2 / scale)) + 1e-9 AS t FROM uu, m GROUP BY 1),
z AS (SELECT row_id, anchor_id, exp(-d2 / scale) AS w FROM d, m),
a AS (SELECT row_id, anchor_id, w / (sum(w) OVER (PARTITION BY row_id) + 1e-9) / t AS w FROM z JOIN du USING (anchor_id)),
y AS (SELECT * FROM a) {_ROWS}""",
    "q_simplex": f"""{_BASE}, s AS (SELECT row_id, k, 4 * v AS v, row_number() OVER o AS j, sum(4 * v) OVER (o ROWS UNBOUNDED PRECEDING) AS c
  FROM e WINDOW o AS (PARTITION BY row_id ORDER BY v DESC, k)),
t AS (SELECT row_id, max_by((c - 1) / j, j) FILTER (v - (c - 1) / j > 0) AS theta FROM s GROUP BY 1)
SELECT row_id, CAST(k AS BIGINT) AS k, round(greatest(v - theta, 0), 6) + 0.0 AS w FROM s JOIN t USING (row_id)""",
    "q_lae_pair": f"""{_BASE}, two AS (SELECT row_id, max(anchor_id) FILTER (rank = 1) AS a, max(anchor_id) FILTER (rank = 2) AS b FROM nn WHERE rank <= 2 GROUP BY 1)
SELECT row_id, a AS anchor_id, round(least(greatest(sum((e.v - q.v) * (p.v - q.v)) / sum((p.v - q.v) * (p.v - q.v)), 0), 1), 4) AS w
FROM two JOIN e USING (row_id) JOIN u p ON p.anchor_id = a AND p.k = e.k JOIN u q ON q.anchor_id = b AND q.k = e.k GROUP BY ALL""",
    "q_heat_kernel": """WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(range(1, 65), lambda k: a.x[k] * exp(-1.5 * (1 - 1.0 / k)) * b.x[k])), 6) + 0.0 AS h FROM p a, p b""",
    "q_newton_mode": f"""{_ONE_ANCHOR}, {_NEWTON}
SELECT row_id, round(CASE WHEN two = 1 THEN f1 ELSE f0 END, 6) + 0.0 AS f FROM o JOIN done ON anchor_id = g WHERE is_train""",
    "q_newton_evidence": f"""{_ONE_ANCHOR}, {_NEWTON}
SELECT round(sum(n1 * ln(p1) + n0 * ln(1 - p0) - 0.5 * (n1 * (1 - p1) * f1 - n0 * p0 * f0)
  - 0.5 * (n1 * ln(1 + {NEWTON_RIDGE} * p1 * (1 - p1)) + n0 * ln(1 + {NEWTON_RIDGE} * p0 * (1 - p0)) + ln(1 + c * shared))), 4) AS evidence FROM done""",
    "q_gp_mean_blocks": f"""{_ONE_ANCHOR}, t AS (SELECT anchor_id, sum(x0) AS sy, count(*) AS n FROM o WHERE is_train GROUP BY 1)
SELECT row_id, round(coalesce(sy / (n + 0.5), 0), 6) + 0.0 AS y_pred FROM o LEFT JOIN t USING (anchor_id)""",
    "q_label": f"""{_BASE}, f AS (SELECT row_id, sum(v * CASE k WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 3 ELSE -4 END) AS f FROM e WHERE k < 4 GROUP BY 1)
SELECT row_id, round(1 / (1 + exp(-f)), 6) + 0.0 AS pi, CASE WHEN f > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_pred FROM f""",
    "q_one_vs_rest": "SELECT vec_id AS row_id, j.range AS class, CAST(label = j.range AS DOUBLE) AS y FROM embeddings, range(10) j",
    "q_argmax": f"{_BASE} SELECT row_id, k::BIGINT AS y_pred FROM e QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY v DESC, k) = 1",
    "q_nll_regression": """WITH r AS (SELECT embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS m, 1 + abs(embedding[3]::DOUBLE) AS s FROM embeddings)
SELECT round(0.5 * (avg((y - m) * (y - m) / s + ln(s + 1e-9)) + ln(2 * pi())), 6) + 0.0 AS nll FROM r""",
    "q_gp_mean": f"""{_BASE}, g AS (SELECT a.anchor_id AS i, b.anchor_id AS j, sum(a.v * b.v) AS c FROM u a JOIN u b USING (k) WHERE a.anchor_id < 2 AND b.anchor_id < 2 GROUP BY ALL),
c AS (SELECT max(c) FILTER (i = 0 AND j = 0) + 0.5 AS a, max(c) FILTER (i = 0 AND j = 1) AS b, max(c) FILTER (i = 1 AND j = 1) + 0.5 AS d FROM g),
x AS (SELECT e.row_id, sum(e.v * u.v) FILTER (anchor_id = 0) AS p, sum(e.v * u.v) FILTER (anchor_id = 1) AS q FROM e JOIN u USING (k) WHERE anchor_id < 2 GROUP BY 1)
SELECT row_id, round((p * (d + b) - q * (b + a)) / (a * d - b * b), 6) + 0.0 AS y_pred FROM x, c""",
    "q_laplace_mode": """WITH RECURSIVE l AS (SELECT DISTINCT label::BIGINT AS label, label + 1.0::DOUBLE AS c, (label % 2)::DOUBLE AS y FROM embeddings),
s AS (SELECT label, c, y, 0.0::DOUBLE AS f, 0 AS n FROM l UNION ALL
  SELECT label, c, y, c * (w * f + y - p) / (1 + c * w), n + 1 FROM (SELECT *, 1 / (1 + exp(-f)) AS p, 1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) AS w FROM s) t WHERE n < 40)
SELECT label, round(f, 6) + 0.0 AS f FROM s WHERE n = 40""",
    "q_split": """WITH p AS (SELECT d.doc_id, l.quality AS y FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT y IS NOT NULL AND doc_id % 2 = 0 AS is_train, count(*) AS n, count(y) AS labelled FROM p GROUP BY 1""",
    "q_text_features": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') AS words FROM documents)
SELECT doc_id, round(ln(1 + length(text)), 6) + 0.0 AS log_chars, round(len(list_distinct(words)) / (len(words) + 1), 6) + 0.0 AS variety,
  round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / (length(text) + 1), 6) + 0.0 AS alpha,
  round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / (length(text) + 1), 6) + 0.0 AS upper,
  round(length(text) / (len(words) + 1), 6) + 0.0 AS word_length FROM d""",
}
