"""Heat-kernel Gaussian processes from point tables to predictions: a graph or spectrum builder times a task.

All fits are transductive: every point shapes the graph, rows with is_train carry labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import gp
from heatloom.functions.arrow import lists, matrix, sum_arrays
from heatloom.functions.rbf import RbfFit, RbfSums, fit_rbf, fit_rbf_by_sums
from heatloom.operators.anchors import subsample
from heatloom.operators.graph import graph_base, graph_eigen
from heatloom.operators.grid import NystromGrid, SeGrid, stacked_moments, targets
from heatloom.operators.latent import TrainingRows
from heatloom.operators.neighbors import nearest_anchors
from heatloom.operators.nystrom import Nystrom
from heatloom.operators.spectrum import LOCAL_VALUES, LocalWeights, Spectrum, heat_kernel, spectrum_from_weights
from heatloom.operators.weights import NORMS, cross_similarity_lae, cross_similarity_se, mean_distance, normalize, se_weights
from heatloom.plans.tasks import run_tasks
from heatloom.sources.points import check_points

#: Training rows by eigenpairs up to which classification takes them to the driver (160 MB), where jobs would cost more than
#: the arithmetic; beyond, they stay in the tasks. A noise for each row and the kernel seen through anchors have no other form.
MAX_TRAIN_VALUES = 20_000_000
#: Values of Gram matrices or eigenvectors of several bandwidths that the driver holds at once (200 MB).
STACKED_VALUES = 25_000_000
#: Training rows by eigenpairs up to which the driver searches a bandwidth's time itself; beyond, each bandwidth is a task.
SEARCHED_VALUES = 200_000
#: Bandwidths that are tried by default, and how many at once.
BANDWIDTHS, AT_ONCE = tuple(float(v) for v in np.exp(np.linspace(math.log(0.1), math.log(10), 10))), 4


@dataclass(frozen=True)
class ModelSpec:
    """How anchors are taken, points are weighed, the graph is normalised, and whether values are square roots."""

    subsample: str = "kmeans"
    kernel: str = "lae"
    gl: str = "cluster-normalized"
    root: bool = True

    def __post_init__(self) -> None:
        for name, value, known in (("subsample", self.subsample, ("kmeans", "random", "minibatchkmeans")), ("kernel", self.kernel, ("lae", "se")), ("gl", self.gl, NORMS)):
            if value not in known:
                raise ValueError(f"unknown {name} {value!r}; one of {', '.join(known)}")


@dataclass
class Fit:
    """A fitted model: its parameters, spectrum and predictions of every point."""

    params: dict
    spectrum: Spectrum
    predictions: DataFrame
    points: DataFrame
    ridge: float = 0.0
    keep: list = field(default_factory=list)

    def release(self) -> None:
        """Lets go of the tables that predictions are computed from, once they are no longer needed."""
        for table in (*self.keep, *self.spectrum.held):
            table.unpersist()

    def covariance(self) -> DataFrame:
        """(i, j, h): the heat kernel of every point i and training point j, with the ridge of classification where they are one."""
        train = self.points.where("is_train").select("row_id")
        right = self.spectrum.vectors.join(train, "row_id", "left_semi")
        h = heat_kernel(self.spectrum.vectors, right, self.spectrum.values, self.params["t"])
        return h.withColumn("h", F.col("h") + F.when(F.col("i") == F.col("j"), F.lit(self.ridge)).otherwise(0.0))


def heat_kernel_spectrum(points: DataFrame, s: int, r: int = 3, k: int = -1, models: ModelSpec = ModelSpec(), epsilon: float = 0.1, nstart: int = 1, seed: int = 0) -> Spectrum:  # noqa: B008
    """Anchors, weights, normalisation and spectrum in one."""
    anchors = subsample(points, s, models.subsample, nstart, seed)
    r = min(r, len(anchors.u))
    if models.kernel == "lae":
        z = cross_similarity_lae(points, anchors, r, models.gl)
    else:
        z = cross_similarity_se(points, anchors, r, epsilon, models.gl)
    z = z.persist()
    spec = spectrum_from_weights(z, len(anchors.u), k, models.root)
    return replace(spec, held=(z,))


def heat_kernel_covariance(points: DataFrame, s: int, r: int, t: float, k: int = -1, models: ModelSpec = ModelSpec(), epsilon: float = 0.1, nstart: int = 1, seed: int = 0) -> DataFrame:  # noqa: B008
    """(i, j, h) of all points i and training points j."""
    check_points(points)
    spec = heat_kernel_spectrum(points, s, r, k, models, epsilon, nstart, seed)
    return heat_kernel(spec.vectors, spec.vectors.join(points.where("is_train").select("row_id"), "row_id", "left_semi"), spec.values, t)


def lae_eigenmap(points: DataFrame, s: int, r: int = 3, ndim: int = 2, method: str = "kmeans", norm: str = "cluster-normalized", nstart: int = 1, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Laplacian eigenvalues (1 - sqrt of the similarity's) and the embedding (row_id, v), the trivial coordinate first."""
    check_points(points)
    spec = heat_kernel_spectrum(points, s, r, ndim + 1, ModelSpec(method, "lae", norm, True), nstart=nstart, seed=seed)
    return 1 - spec.values, spec.vectors


def one_vs_rest(points: DataFrame, classes: int, label: str = "y") -> DataFrame:
    """(row_id, class, y): 1.0 where a row's label is the class, else 0.0; a row for each point and class."""
    each = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    return points.select("row_id", F.col(label).cast("int").alias("label"), each.alias("class")).select("row_id", "class", (F.col("label") == F.col("class")).cast("double").alias("y"))


# --- spectra, one for each bandwidth ---------------------------------------------------------------


@dataclass
class Candidates:
    """The bandwidths of a builder, the spectrum of training rows for each, and that of all rows for the best."""

    a2s: list[float | None]
    train: Callable[[float | None], Spectrum]
    whole: Callable[[float | None], Spectrum]
    held: list = field(default_factory=list)
    at_once: int = AT_ONCE


def candidates(points: DataFrame, method: str, s: int | None, r: int, k: int, a2s, models: ModelSpec, nstart: int, threshold: float, sparse: bool, seed: int) -> Candidates:
    grid = list(BANDWIDTHS if a2s is None else a2s)
    if method == "lae":
        spec = heat_kernel_spectrum(points, s, r, k, models, nstart=nstart, seed=seed)
        return Candidates([None], lambda _: spec, lambda _: spec)
    if method == "se":
        anchors = subsample(points, s, models.subsample, nstart, seed)
        near = nearest_anchors(points, anchors.u, min(r, len(anchors.u))).persist()
        mean = mean_distance(near)
        if near.count() * len(anchors.u) > LOCAL_VALUES:
            at_once = max(1, STACKED_VALUES // len(anchors.u) ** 2)
            made: dict[int, SeGrid] = {}

            def stacked(a2: float) -> Spectrum:
                part, a = divmod(grid.index(a2), at_once)
                if part not in made:
                    made.clear()
                    made[part] = SeGrid(near, anchors, [b * mean for b in grid[part * at_once : (part + 1) * at_once]], models.gl, k, models.root)
                return made[part].spectrum(a)

            return Candidates(grid, stacked, stacked, [near], 1)  # sums of all bandwidths come with the first
        build = lambda a2: spectrum_from_weights(normalize(se_weights(near, a2 * mean), anchors, models.gl), len(anchors.u), k, models.root)
        few = LocalWeights.of(near, "d2")

        def local(a2: float) -> Spectrum:
            z = LocalWeights(few.ids, few.idx, np.exp(-few.w / (a2 * mean))).normalized(anchors.size, models.gl)
            values, v = z.spectrum(len(anchors.u), k, models.root)
            return Spectrum(values, None, (few.ids, v))

        return Candidates(grid, local, build, [near], 1)  # plain arithmetic: threads would only contend
    if method == "nystrom":
        u = subsample(points, s, models.subsample, nstart, seed).u
        train = points.where("is_train").persist()

        stack = NystromGrid(u, grid, k, train) if len(grid) * len(u) * (len(u) if k < 0 else min(k, len(u))) <= STACKED_VALUES else None

        def extended(rows: DataFrame) -> Callable[[float], Spectrum]:
            def build(a2: float) -> Spectrum:
                n = stack.model(a2) if stack else Nystrom.build(u, a2, k)
                return Spectrum(n.values, n.vectors_of(rows), moments=(lambda points: stack.moments(points, a2)) if stack else None)

            return build

        return Candidates(grid, extended(train), extended(points), [train])
    if method == "gl":
        if k == 1:  # a walk's leading pair is the constant, whatever the edges: no graph has to be built for it
            constant = Spectrum(np.ones(1), points.select("row_id", F.array(F.lit(1.0)).alias("v")))
            return Candidates(grid, lambda _: constant, lambda _: constant)
        graph = graph_base(points, threshold, sparse)
        made: dict[float, Spectrum] = {}

        def build(a2: float) -> Spectrum:
            if a2 not in made:
                made[a2] = graph_eigen(points, graph, a2, k)
            return made[a2]

        return Candidates(grid, build, build, [graph.rows] if graph.rows is not None else [], 1)  # a bandwidth starts from the vectors of the one before
    raise ValueError(f"unknown method {method!r}; one of lae, se, nystrom, gl")


def best_of(found: Candidates, fit: Callable[[Spectrum], object], objective: Callable[[object], float]) -> tuple[float | None, object]:
    """The bandwidth of the largest objective, the first of equals; several are tried at once."""
    with ThreadPoolExecutor(found.at_once) as pool:
        fits = list(pool.map(lambda a2: fit(found.train(a2)), found.a2s))
    return best_fit(found, fits, objective)


def best_fit(found: Candidates, fits: list, objective: Callable[[object], float]) -> tuple[float | None, object]:
    scores = [objective(f) for f in fits]
    if not np.isfinite(scores).any():
        raise FloatingPointError("no bandwidth has a finite objective")
    best = int(np.argmax(np.where(np.isfinite(scores), scores, -np.inf)))
    return found.a2s[best], fits[best]


def training_labels(points: DataFrame, columns: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """ids (ascending) and label columns of the training rows."""
    wide = {c for c, kind in points.dtypes if kind.startswith("array")}
    got = points.where("is_train").select("row_id", *columns).toArrow().combine_chunks()
    if not got.num_rows:
        raise ValueError("there are no training rows")
    if any(got.column(c).null_count for c in columns):
        raise ValueError("training rows must have labels")
    ids = got.column(0).chunk(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    read = lambda c: matrix(got.column(c).chunk(0), len(got.column(c)[0])) if c in wide else got.column(c).chunk(0).to_numpy(zero_copy_only=False).astype(float)
    return ids[order], {c: read(c)[order] for c in columns}


def training_vectors(points: DataFrame, spectrum: Spectrum, ids: np.ndarray) -> np.ndarray:
    """The vectors of the training rows ``ids``, in their order."""
    if len(ids) * len(spectrum.values) > MAX_TRAIN_VALUES:
        raise ValueError(f"{len(ids)} training rows by {len(spectrum.values)} eigenpairs don't fit the driver; take fewer of either")
    if spectrum.local:
        return spectrum.local[1][np.searchsorted(spectrum.local[0], ids)]
    got = spectrum.vectors.join(points.where("is_train").select("row_id"), "row_id", "left_semi").select("row_id", "v").toArrow().combine_chunks()
    return matrix(got.column(1).chunk(0), len(spectrum.values))[np.argsort(got.column(0).chunk(0).to_numpy(), kind="stable")]


def searches(points: DataFrame, found: Candidates, ids: np.ndarray, targets: list[np.ndarray], pairs: int, search: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """What ``search`` of vectors, values and a target gives for each bandwidth and target, each bandwidth's target in a task of its own.

    The driver holds the vectors of as many bandwidths as ``STACKED_VALUES`` allows, and only reads them: searches beside each other on one machine contend.
    """
    spark, width = points.sparkSession, max(1, STACKED_VALUES // (len(ids) * pairs))
    out: list[list[tuple[float, float]]] = []

    def vectors(a2: float | None) -> tuple[np.ndarray, np.ndarray]:
        spec = found.train(a2)
        return training_vectors(points, spec, ids), spec.values

    with ThreadPoolExecutor(found.at_once) as pool:
        for at in range(0, len(found.a2s), width):
            group = list(pool.map(vectors, found.a2s[at : at + width]))
            if len(ids) * pairs <= SEARCHED_VALUES:
                times = [search(*g, y) for g in group for y in targets]
            else:
                sent = [spark.sparkContext.broadcast(x) for x in (*group, *targets)]  # a task reads one of each
                places = [(i, len(group) + j) for i in range(len(group)) for j in range(len(targets))]
                times = run_tasks(spark, lambda p: search(*sent[p[0]].value, sent[p[1]].value), places)  # noqa: B023
                for b in sent:
                    b.destroy()
            out += [times[i : i + len(targets)] for i in range(0, len(times), len(targets))]
    return out


def training_rows(points: DataFrame, spectrum: Spectrum, of_class: int | None = None) -> TrainingRows:
    """The training rows' vectors and labels, left in the tasks."""
    vectors = spectrum.vectors
    if vectors is None:
        ids, v = spectrum.local
        vectors = points.sparkSession.createDataFrame(pa.table({"row_id": pa.array(ids, pa.int64()), "v": lists(v)}))
    return TrainingRows(points, vectors, len(spectrum.values), of_class)


def stay_in_tasks(points: DataFrame, pairs: int, low: float, high: str) -> tuple[bool, float]:
    """Whether training rows by ``pairs`` are too many for the driver, and the largest label; labels outside ``low`` and ``high`` raise."""
    y = F.col("y").cast("double")
    wrong = y.isNull() | F.isnan(y) | (y < low) | (y > F.expr(high))
    got = points.where("is_train").agg(F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("wrong"), F.max(y).alias("most")).first()
    if not got["n"]:
        raise ValueError("there are no training rows")
    if got["wrong"]:
        raise ValueError("training rows must have labels, from 0 to the number of trials or classes")
    return got["n"] * pairs > MAX_TRAIN_VALUES, got["most"]


def moments(points: DataFrame, spectrum: Spectrum, known: Callable[[], tuple]) -> gp.Moments:
    """V'V, V'Y, Y'Y and the count of training rows, summed where they lie (or on the driver, where the vectors are)."""
    if spectrum.local:
        ids, labels = known()
        return gp.Moments.of(training_vectors(points, spectrum, ids), labels["y"])
    if spectrum.moments:
        return spectrum.moments(points)
    rows = spectrum.vectors.join(targets(points), "row_id").select("v", "ys")
    return stacked_moments(rows, [lambda batch: matrix(batch.column(0), len(batch.column(0)[0]))], [len(spectrum.values)])[0]


def project(vectors: DataFrame, schema: str, f: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """Columns of every row from its id and vector, by ``f`` on blocks of them."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch.column(0).to_numpy(), matrix(batch.column(1), len(batch.column(1)[0])))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c) if np.ndim(c) > 1 else c) for c in out]], names=["row_id", *names])

    return vectors.select("row_id", "v").mapInArrow(run, f"row_id long, {schema}")


def quadratic(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.einsum("nk,kl,nl->n", v, m, v, optimize=True)


def _rank(method: str, s: int | None, k: int) -> int:
    if method == "gl":
        if k < 1:
            raise ValueError("the full graph needs a number of eigenpairs")
        return k
    if s is None:
        raise ValueError("a number of anchors is needed")
    return s if k < 0 else min(k, s)


def fit_regression(points: DataFrame, method: str = "lae", s: int | None = None, r: int = 3, k: int = -1, sigma: float = 1e-5, a2s=None, approach: str = "posterior", noise: str = "same", models: ModelSpec = ModelSpec(), threshold: float = 0.01, sparse: bool = True, nstart: int = 1, seed: int = 0) -> Fit:  # noqa: B008
    """Regression: row_id, is_train, y_pred, var of every point (y_pred is an array where y is).

    One noise needs only moments of the training rows, whatever their number; noise "different" fits one for each.
    """
    gp.check_approach(approach)
    if noise not in ("same", "different"):
        raise ValueError(f"noise must be same or different, not {noise!r}")
    check_points(points)
    found = candidates(points, method, s, r, _rank(method, s, k), a2s, models, nstart, threshold, sparse, seed)

    known = cache(lambda: training_labels(points, ["y"]))

    def one(spec: Spectrum) -> gp.RegressionFit:
        if noise == "same":
            return gp.fit_regression(moments(points, spec, known), spec.values, sigma, approach)
        ids, labels = known()
        return gp.fit_regression_pointwise(training_vectors(points, spec, ids), labels["y"], spec.values, sigma, approach)

    a2, best = best_of(found, one, lambda b: b.objective)
    spec = found.whole(a2)
    many = dict(points.dtypes)["y"].startswith("array")
    predicted = project(spec.vectors, f"y_pred {'array<double>' if many else 'double'}, var double", lambda _, v: [(v @ best.mean) if many else (v @ best.mean)[:, 0], quadratic(v, best.spread) + best.floor])
    out = predicted.join(points.select("row_id", "is_train"), "row_id").select("row_id", "is_train", "y_pred", "var")
    return Fit({"t": best.t, "noise": best.noise, "a2": a2, "sigma": sigma, "objective": best.objective}, spec, out, points, keep=found.held)


def fit_logit(points: DataFrame, method: str = "lae", s: int | None = None, r: int = 3, k: int = -1, sigma: float = 1e-3, a2s=None, approach: str = "posterior", models: ModelSpec = ModelSpec(), threshold: float = 0.01, sparse: bool = True, nstart: int = 1, seed: int = 0, sweeps: int = 100, average: bool = False) -> Fit:  # noqa: B008
    """Binary (or binomial, with n_trials) classification: row_id, is_train, y_pred, pi, mean, var of every point."""
    check_points(points)
    found = candidates(points, method, s, r, _rank(method, s, k), a2s, models, nstart, threshold, sparse, seed)
    columns = ["y", "n_trials"] if "n_trials" in points.columns else ["y"]

    far, _ = stay_in_tasks(points, _rank(method, s, k), 0, "n_trials" if len(columns) > 1 else "1")
    if far:
        return _logit_in_tasks(points, found, sigma, approach, sweeps, seed, average)
    ids, labels = training_labels(points, columns)
    y, trials = labels["y"], labels.get("n_trials", np.ones(len(ids)))

    times = searches(points, found, ids, [y], _rank(method, s, k), lambda v, values, t: gp.best_time(v, values, t, trials, sigma, approach))
    a2, (time,) = best_fit(found, times, lambda b: b[0][-1])
    spec = found.whole(a2)
    best = gp.fit_logit(training_vectors(points, spec, ids), spec.values, y, trials, sigma, approach, sweeps, seed, average=average, best=time)

    def predict(rows: np.ndarray, x: np.ndarray) -> list:
        at = np.minimum(np.searchsorted(ids, rows), len(ids) - 1)
        own = np.where(ids[at] == rows, best.own[at], 0.0)
        pi = gp.sigmoid(x @ best.label + own)
        return [(pi > 0.5).astype(float), pi, x @ best.mean, quadratic(x, best.spread) + sigma]

    predicted = project(spec.vectors, "y_pred double, pi double, mean double, var double", predict)
    out = predicted.join(points.select("row_id", "is_train"), "row_id").select("row_id", "is_train", "y_pred", "pi", "mean", "var")
    return Fit({"t": best.t, "a2": a2, "sigma": sigma, "objective": best.objective}, spec, out, points, sigma, found.held)


def _logit_in_tasks(points: DataFrame, found: Candidates, sigma: float, approach: str, sweeps: int, seed: int, average: bool) -> Fit:
    """``fit_logit`` of training rows that stay in the tasks, by sums over them."""

    def one(spec: Spectrum) -> tuple[float, float]:
        rows = training_rows(points, spec)
        try:
            return rows.best_time(spec.values, sigma, approach)
        finally:
            rows.release()

    found.at_once = 1
    a2, best = best_of(found, one, lambda b: b[-1])
    spec = found.whole(a2)
    rows = training_rows(points, spec)
    best, own = rows.fit(spec.values, sigma, approach, sweeps, seed, average=average, best=best)
    rows.release()
    predicted = project(spec.vectors, "latent double, mean double, var double", lambda _, x: [x @ best.label, x @ best.mean, quadratic(x, best.spread) + sigma])
    latent = F.col("latent") + sigma * F.coalesce("own", F.lit(0.0))
    out = predicted.join(points.select("row_id", "is_train"), "row_id").join(own, "row_id", "left").withColumn("pi", 0.5 * (1 + F.tanh(0.5 * latent)))
    out = out.select("row_id", "is_train", (F.col("pi") > 0.5).cast("double").alias("y_pred"), "pi", "mean", "var")
    return Fit({"t": best.t, "a2": a2, "sigma": sigma, "objective": best.objective}, spec, out, points, sigma, found.held)


def fit_multinomial(points: DataFrame, method: str = "lae", s: int | None = None, r: int = 3, k: int = -1, sigma: float = 1e-3, a2s=None, approach: str = "posterior", models: ModelSpec = ModelSpec(), threshold: float = 0.01, sparse: bool = True, nstart: int = 1, seed: int = 0, sweeps: int = 100) -> Fit:  # noqa: B008
    """One-versus-rest classification of labels 0 to J - 1: row_id, is_train, y_pred, pi, mean, var (arrays by class).

    A bandwidth's objective is the sum of its classes'; classes are tasks of their own. The class of the
    largest probability is predicted, the first of equals.
    """
    check_points(points)
    spark = points.sparkSession
    found = candidates(points, method, s, r, _rank(method, s, k), a2s, models, nstart, threshold, sparse, seed)

    far, most = stay_in_tasks(points, _rank(method, s, k), 0, "floor(y)")
    classes = int(most) + 1
    if far:  # class by class, by sums over tasks
        found.at_once = 1

        def each(spec: Spectrum, f: Callable[[TrainingRows, int], object]) -> list:
            out = []
            for j in range(classes):
                rows = training_rows(points, spec, j)
                out.append(f(rows, j))
                rows.release()
            return out

        a2, times = best_of(found, lambda spec: each(spec, lambda rows, _: rows.best_time(spec.values, sigma, approach)), lambda b: sum(o for _, o in b))
        spec, objective = found.whole(a2), sum(o for _, o in times)
        fits = each(spec, lambda rows, j: rows.fit(spec.values, sigma, approach, sweeps, seed, ridge_in_posterior=False, best=times[j])[0])
    else:
        ids, labels = training_labels(points, ["y"])
        y, ones = labels["y"].astype(int), np.ones(len(ids))
        targets = [(y == j).astype(float) for j in range(classes)]

        found_times = searches(points, found, ids, targets, _rank(method, s, k), lambda v, values, t: gp.best_time(v, values, t, np.ones(len(t)), sigma, approach))
        a2, times = best_fit(found, found_times, lambda b: sum(o for _, o in b))
        spec, objective = found.whole(a2), sum(o for _, o in times)
        v, values = training_vectors(points, spec, ids), spec.values
        fits = run_tasks(spark, lambda c: gp.fit_logit(v, values, c[0], ones, sigma, approach, sweeps, seed, ridge_in_posterior=False, ridge_in_labels=False, best=c[1]), list(zip(targets, times, strict=True)))
    label, mean = np.stack([f.label for f in fits], 1), np.stack([f.mean for f in fits], 1)

    def predict(_: np.ndarray, x: np.ndarray) -> list:
        pi = gp.sigmoid(x @ label)
        var = np.stack([quadratic(x, f.spread) + sigma for f in fits], 1)
        return [pi.argmax(1).astype(np.int32), pi, x @ mean, var]

    predicted = project(spec.vectors, "y_pred int, pi array<double>, mean array<double>, var array<double>", predict)
    out = predicted.join(points.select("row_id", "is_train"), "row_id").select("row_id", "is_train", "y_pred", "pi", "mean", "var")
    return Fit({"t": [f.t for f in fits], "a2": a2, "sigma": sigma, "objective": objective}, spec, out, points, sigma, found.held)


def rbf_sums(points: DataFrame, u: np.ndarray, d: int) -> Callable[[list[float]], list[RbfSums]]:
    """Sums over the training rows, which stay in the tasks, for several t in one pass."""
    rows = points.where("is_train").select("x", F.col("y").cast("double").alias("y"))
    if rows.where(F.col("y").isNull() | F.isnan("y")).limit(1).count():
        raise ValueError("training rows must have labels")

    def passed(times: list[float]) -> list[RbfSums]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x, y = matrix(part.column(0), d), part.column(1).to_numpy()[:, None]
                    flat = np.concatenate([RbfSums.flat(x, y, u, t) for t in times])
                    total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["a"])

        return [RbfSums.of(x, len(u)) for x in sum_arrays(rows.mapInArrow(run, "a array<double>")).reshape(len(times), -1)]

    return passed


def fit_rbf_regression(points: DataFrame, s: int, sigma: float = 1e-5, noise: str = "same", approach: str = "posterior", subsample_method: str = "kmeans", nstart: int = 1, seed: int = 0) -> tuple[RbfFit, DataFrame]:
    """A squared-exponential kernel seen through anchors: the fit, and row_id, is_train, y_pred of every point."""
    d = check_points(points)
    u = subsample(points, s, subsample_method, nstart, seed).u
    if noise == "same" and points.where("is_train").count() * max(d, len(u)) > MAX_TRAIN_VALUES:
        fit = fit_rbf_by_sums(rbf_sums(points, u, d), u, sigma, approach)
    else:
        ids, labels = training_labels(points, ["y"])
        if len(ids) * max(d, len(u)) > MAX_TRAIN_VALUES:
            raise ValueError(f"a noise for each of {len(ids)} training rows doesn't fit the driver; take one noise")
        got = points.where("is_train").select("row_id", "x").toArrow().combine_chunks()
        x = matrix(got.column(1).chunk(0), d)[np.argsort(got.column(0).chunk(0).to_numpy(), kind="stable")]
        fit = fit_rbf(x, labels["y"], u, sigma, noise, approach)
    predicted = project(points.withColumnRenamed("x", "v"), "y_pred double", lambda _, v: [fit.predict(v)[:, 0]])
    return fit, predicted.join(points.select("row_id", "is_train"), "row_id").select("row_id", "is_train", "y_pred")


# --- the twelve named fits -------------------------------------------------------------------------


def fit_lae_regression_gp(points: DataFrame, s: int, r: int = 3, k: int = -1, **options) -> Fit:
    return fit_regression(points, "lae", s, r, k, **options)


def fit_se_regression_gp(points: DataFrame, s: int, r: int = 3, k: int = -1, **options) -> Fit:
    return fit_regression(points, "se", s, r, k, **options)


def fit_nystrom_regression_gp(points: DataFrame, s: int, k: int = -1, **options) -> Fit:
    return fit_regression(points, "nystrom", s, k=k, **options)


def fit_gl_regression_gp(points: DataFrame, k: int, **options) -> Fit:
    return fit_regression(points, "gl", k=k, **options)


def fit_lae_logit_gp(points: DataFrame, s: int, r: int = 3, k: int = -1, **options) -> Fit:
    return fit_logit(points, "lae", s, r, k, **options)


def fit_se_logit_gp(points: DataFrame, s: int, r: int = 3, k: int = -1, **options) -> Fit:
    return fit_logit(points, "se", s, r, k, **options)


def fit_nystrom_logit_gp(points: DataFrame, s: int, k: int = -1, **options) -> Fit:
    return fit_logit(points, "nystrom", s, k=k, **options)


def fit_gl_logit_gp(points: DataFrame, k: int, **options) -> Fit:
    return fit_logit(points, "gl", k=k, **options)


def fit_lae_logit_mult_gp(points: DataFrame, s: int, r: int = 3, k: int = -1, **options) -> Fit:
    return fit_multinomial(points, "lae", s, r, k, **options)


def fit_se_logit_mult_gp(points: DataFrame, s: int, r: int = 3, k: int = -1, **options) -> Fit:
    return fit_multinomial(points, "se", s, r, k, **options)


def fit_nystrom_logit_mult_gp(points: DataFrame, s: int, k: int = -1, **options) -> Fit:
    return fit_multinomial(points, "nystrom", s, k=k, **options)


def fit_gl_logit_mult_gp(points: DataFrame, k: int, **options) -> Fit:
    return fit_multinomial(points, "gl", k=k, **options)
