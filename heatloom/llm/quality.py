"""Quality scores by co-training a text view and a metadata view."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import slices, written
from heatloom.llm.learning import Logistic, fit_logistic, held_out, labelled_sample, sigmoid

#: Labelled documents that a model is fitted on at most.
SAMPLE = 20_000
#: Rounds; the share of the number of labelled rows that a view hands over in a round; how sure it must be; a pseudo-label's weight.
ROUNDS, SHARE, SURE, PSEUDO = 5, 0.1, 0.9, 0.3
#: The penalty of a feature, that of a bucket of grams, and folds of calibration.
RIDGE, GRAM_RIDGE, FOLDS = 1.0, 30.0, 4
#: Buckets that languages and sources are hashed into, and bits of those of runs of four bytes and of words.
LANG_BUCKETS, SOURCE_BUCKETS, GRAM_BITS = 8, 16, 7

_CLASSES = np.full(256, 5, np.int8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 sign, 6 beyond ASCII
_CLASSES[ord("a") : ord("z") + 1], _CLASSES[ord("A") : ord("Z") + 1], _CLASSES[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASSES[[9, 11, 12, 13, 32]], _CLASSES[10], _CLASSES[128:] = 3, 4, 6


def surface(text: str) -> list[float]:
    """A text's size, kinds of characters, variety of words and repeated lines."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASSES, weights=counts, minlength=7) / (len(raw) + 1)
    words = text.split()
    n = len(words)
    used = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    top = used.most_common(1)[0][1] / n if n else 0.0
    followed = sum(map(str.__eq__, words, words[1:])) / n if n else 0.0
    signs = np.delete(counts[33:65], np.arange(15, 25)).max(initial=0) / (len(raw) + 1)
    base = [
        math.log1p(n), len(used) / (n + 1), len(text) / (n + 1), top, followed, float(signs),
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(text) / (len(lines) + 1)), *kinds.tolist(),
    ]
    return [*base, *[x * x for x in base]]


def grams(text: str) -> bytes:
    """A byte for each bucket of the lower-case text's runs of four bytes and of its words: 255 times the root of its share."""
    low = text.lower()
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    runs = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24 if len(raw) > 3 else raw[:0]
    words = Counter(low.split())
    of_word = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)
    out = []
    for hashes, weights in ((runs, None), (of_word, np.fromiter(words.values(), float, len(words)))):
        bucket = (hashes * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
        share = np.bincount(bucket, weights, minlength=1 << GRAM_BITS) / max(1, len(hashes) if weights is None else weights.sum())
        out.append(np.rint(255 * np.sqrt(share)).astype(np.uint8))
    return np.concatenate(out).tobytes()


SURFACE_DIMS, GRAM_DIMS, META_DIMS = 30, 2 << GRAM_BITS, LANG_BUCKETS + SOURCE_BUCKETS + 2


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What the metadata alone show: language and source by hashed buckets, and the stated length."""
    out = [0.0] * META_DIMS
    out[xxhash.xxh64_intdigest(lang or "", 1) % LANG_BUCKETS] = 1.0
    out[LANG_BUCKETS + xxhash.xxh64_intdigest(source or "", 2) % SOURCE_BUCKETS] = 1.0
    size = math.log1p(max(n_chars or 0, 0))
    out[-2:] = [size, size * size]
    return out


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """doc_id, the text view (t and g) and the metadata view (m) of every row, from whole texts; missing metadata columns and nulls count as empty."""
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), have(lang_col, "string").alias("lang"), have(source_col, "string").alias("source"), have(chars_col, "long").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for batch in slices(batches):
            ids, texts, *meta = (batch.column(i) for i in range(5))
            t, g = [], []
            for text in texts.to_pylist():
                t.append(surface(text or ""))
                g.append(grams(text or ""))
            m = [meta_view(*x) for x in zip(*(c.to_pylist() for c in meta), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(t, kind), pa.array(g, pa.binary()), pa.array(m, kind)], names=["doc_id", "t", "g", "m"])

    return rows.mapInArrow(run, "doc_id long, t array<float>, g binary, m array<float>")


def matrices(t: pa.Array, g: pa.Array, m: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both views as matrices of a row each."""
    n = len(t)
    dense = lambda c, d: c.flatten().to_numpy(zero_copy_only=False).reshape(n, d).astype(float) if n else np.zeros((0, d))
    raw = np.frombuffer(b"".join(g.to_pylist()), np.uint8).reshape(n, GRAM_DIMS) / 255
    return np.hstack([dense(t, SURFACE_DIMS), raw]), dense(m, META_DIMS)


@dataclass(frozen=True)
class CoTrained:
    text: Logistic
    meta: Logistic
    calibrate: tuple[Logistic, Logistic] | None  # from a view's margin to its probability
    combine: Logistic | None  # from both calibrated log odds

    def margins(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.c_[self.text.margin(t), self.meta.margin(m)]

    def log_odds(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Calibrated margins of both views, a column each."""
        z = self.margins(t, m)
        return z if self.calibrate is None else np.c_[self.calibrate[0].margin(z[:, :1]), self.calibrate[1].margin(z[:, 1:])]

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, metadata and combined score."""
        z = self.log_odds(t, m)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(z.mean(1)) if self.combine is None else self.combine.score(z)


@dataclass
class Rows:
    """Rows with labels: both views, labels, and weights."""

    t: np.ndarray
    m: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        table = table.combine_chunks()
        columns = [table.column(c).chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("t", "g", "m")]
        return cls(*matrices(*columns), table.column("y").to_numpy().astype(float))


def folds_of(y: np.ndarray) -> np.ndarray:
    """The fold of each row: rows of a class in turn."""
    out = np.zeros(len(y), int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        out[at] = np.arange(len(at)) % FOLDS
    return out


def quotas(y: np.ndarray) -> tuple[int, int]:
    """How many rows of class 0 and of class 1 a view hands over in a round: a share of the labelled rows, by the classes' rates."""
    total = max(2, round(SHARE * len(y)))
    ones = min(total - 1, max(1, round(total * float(y.mean())))) if len(y) else 1
    return total - ones, ones


def surest(features: DataFrame, model: CoTrained, quota: tuple[int, int], taken: tuple[frozenset, frozenset]) -> tuple[pa.Table, pa.Table]:
    """What the text and the metadata view hand over: of each class the rows of ``features`` that the view is surest of.

    All rows are scored. A task keeps its best rows of each view and class, so that as many as the quotas say, and not
    more, come from each task, and as many in all to the driver. Rows that the view handed over before are
    left out; of equally sure rows the first by a hash of the id and views.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            odds = model.log_odds(*matrices(batch.column(1), batch.column(2), batch.column(3)))
            ids, tie = batch.column(0).to_pylist(), batch.column(4)
            for view in (0, 1):
                p = sigmoid(odds[:, view])
                free = np.fromiter((i not in taken[view] for i in ids), bool, len(ids))
                for label in (0, 1):
                    sure = p if label else 1 - p
                    at = np.flatnonzero(free & (sure >= SURE))
                    picked = pa.Table.from_batches([batch.take(pa.array(at))])
                    n = len(at)
                    picked = picked.append_column("view", pa.array(np.full(n, view, np.int32))).append_column("y", pa.array(np.full(n, label, np.int32))).append_column("sure", pa.array(sure[at]))
                    before = best.get((view, label))
                    both = pa.concat_tables([before, picked]) if before is not None else picked
                    best[view, label] = both.sort_by([("sure", "descending"), ("tie", "ascending")]).slice(0, quota[label])
        for found in best.values():
            yield from found.combine_chunks().to_batches()

    schema = "doc_id long, t array<float>, g binary, m array<float>, tie long, view int, y int, sure double"
    found = written(features.withColumn("tie", F.xxhash64("doc_id", "t", "g", "m")).mapInArrow(run, schema))
    each = [found.where((F.col("view") == v) & (F.col("y") == y)).orderBy(F.desc("sure"), "tie").limit(quota[y]).toArrow() for v in (0, 1) for y in (0, 1)]
    return pa.concat_tables(each[:2]), pa.concat_tables(each[2:])


def penalty(dims: int) -> np.ndarray:
    """The penalty of each feature of a view."""
    out = np.full(dims, RIDGE)
    if dims == SURFACE_DIMS + GRAM_DIMS:
        out[SURFACE_DIMS:] = GRAM_RIDGE
    return out


def co_train(known: Rows, hand_over: Callable[[CoTrained, tuple[int, int], tuple[frozenset, frozenset]], tuple[pa.Table, pa.Table]], rounds: int = ROUNDS) -> CoTrained:
    """Each round each view labels the unlabelled rows that it is surest of, for the other view to learn from.

    How sure a view is follows from its calibration on the labelled rows, so a view that says nothing hands over nothing.
    Views are calibrated, and at the end combined, on margins from models that were fitted without the row's fold.
    """
    quota, fold = quotas(known.y), folds_of(known.y)
    got: list[list[Rows]] = [[], []]  # for the text and for the metadata view to learn from
    taken: list[frozenset] = [frozenset(), frozenset()]  # ids that the text and the metadata view gave

    def train(view: int, rows: np.ndarray) -> Logistic:
        own = (known.t, known.m)[view][rows]
        y = np.concatenate([known.y[rows], *[r.y for r in got[view]]])
        weight = np.r_[np.ones(len(own)), np.full(len(y) - len(own), PSEUDO)]
        return fit_logistic(np.concatenate([own, *[(r.t, r.m)[view] for r in got[view]]]), y, weight, penalty(own.shape[1]))

    def calibrated() -> tuple[np.ndarray, tuple[Logistic, Logistic]]:
        z = np.zeros((len(known.y), 2))
        for f in range(FOLDS):
            if (fold == f).any():
                z[fold == f] = CoTrained(train(0, fold != f), train(1, fold != f), None, None).margins(known.t[fold == f], known.m[fold == f])
        return z, tuple(fit_logistic(z[:, v : v + 1], known.y, ridge=0.1) for v in (0, 1))

    every = np.ones(len(known.y), bool)
    models = (train(0, every), train(1, every))
    if len(np.unique(known.y)) < 2:
        return CoTrained(*models, None, None)
    z, calibrate = calibrated()
    for _ in range(rounds):
        handed = hand_over(CoTrained(*models, calibrate, None), quota, tuple(taken))
        for view in (0, 1):
            if handed[view].num_rows:
                got[1 - view].append(Rows.of(handed[view]))
                taken[view] |= frozenset(handed[view].column("doc_id").to_pylist())
        if not sum(h.num_rows for h in handed):
            break
        models = (train(0, every), train(1, every))
    z, calibrate = calibrated()
    both = np.c_[calibrate[0].margin(z[:, :1]), calibrate[1].margin(z[:, 1:])]
    return CoTrained(*models, calibrate, fit_logistic(both, known.y, ridge=0.1))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> CoTrained:
    """Fits on at most ``sample`` labelled rows that aren't held out, and on pseudo-labels of all rows without a label.

    Of rows of one id the greatest counts. Pseudo-labels are a share of the labelled rows in each round, so what the
    driver holds is bounded by the sample, whatever the number of rows that they are picked from.
    """
    picked = labelled_sample(labels, label, sample, id_col)
    rows = features.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "t", "g", "m", "y")  # as many ids as the sample has
    one = rows.groupBy("id").agg(F.max(F.struct("t", "g", "m", "y")).alias("r")).select("id", "r.*")
    known = Rows.of(one.orderBy(F.xxhash64("id"), "id").toArrow())
    named = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("known")).distinct()
    rest = written(features.join(named, F.col("doc_id") == F.col("known"), "left_anti").where("doc_id is not null"))
    return co_train(known, lambda *args: surest(rest, *args))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted and keep of every row.

    Both views are taken from whole texts in one pass and written; models are fitted on a bounded sample of labelled rows
    and the pseudo-labels of all others, and score all rows. Rows and ids may repeat; null texts and
    metadata are empty; a null id is scored and never learned from; equal rows have equal scores, and one half counts as
    good; without labels every score is one half. An empty table gives no rows; other columns are ignored.
    """
    features = written(views(docs, id_col, **columns))
    model = fit(features, labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(*matrices(batch.column(1), batch.column(2), batch.column(3))) if batch.num_rows else (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s, pa.float64()) for s in scores]], names=["doc_id", "text_score", "meta_score", "score"])

    scored = features.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    good = F.col("score") >= 0.5
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "meta_score", "score", good.cast("int").alias("predicted"), good.alias("keep"))
