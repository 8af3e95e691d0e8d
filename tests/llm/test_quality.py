"""Co-training against a version without Spark, and what the exchange of pseudo-labels is worth."""

import numpy as np
import pyarrow as pa

from heatloom.llm import quality
from heatloom.llm.common import table
from heatloom.llm.learning import held_out, labelled_sample


def plain_hand_over(ids, t, g, m):
    """What each view is surest of, from rows in memory."""
    x = np.hstack([t, np.frombuffer(b"".join(g), np.uint8).reshape(len(g), -1) / 255])

    def hand_over(model, quota, taken):
        p = [1 / (1 + np.exp(-z)) for z in model.log_odds(x, m).T]
        out = []
        for view in (0, 1):
            rows, labels = [], []
            for label in (0, 1):
                sure = p[view] if label else 1 - p[view]
                usable = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= quality.SURE and ids[i] not in taken[view]][: quota[label]]
                rows += usable
                labels += [label] * len(usable)
            kinds = {"t": pa.list_(pa.float64()), "m": pa.list_(pa.float64())}
            columns = {"t": [t[i].tolist() for i in rows], "m": [m[i].tolist() for i in rows]}
            out.append(pa.table({"doc_id": pa.array([ids[i] for i in rows], pa.int64()), "g": pa.array([g[i] for i in rows], pa.binary()), "y": pa.array(labels, pa.int32()), **{c: pa.array(v, kinds[c]) for c, v in columns.items()}}))
        return tuple(out)

    return hand_over


def test_scores_equal_a_version_without_spark(spark, sf_dir):
    """Models, rounds, calibration, combination and scores of every document, from views taken one text at a time."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = {r["doc_id"] for r in labels.where("quality is not null").select("doc_id").collect()}
    unlabelled = docs.where("doc_id % 3 = 0").select("doc_id")  # so that there is something to hand over
    labels = labels.join(unlabelled, "doc_id", "left_anti").persist()
    rows = docs.orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    t = np.array([quality.surface(r["text"] or "") for r in rows], np.float32).astype(float)
    g = [quality.grams(r["text"] or "") for r in rows]
    m = np.array([quality.meta_view(r["lang"], r["source"], r["n_chars"]) for r in rows], np.float32).astype(float)
    sample = [(r["id"], r["y"]) for r in labelled_sample(labels, "quality", quality.SAMPLE).selectExpr("id", "y", "xxhash64(id) AS h").orderBy("h", "id").collect()]
    place = {d: i for i, d in enumerate(ids)}
    at = [place[d] for d, _ in sample]
    every = np.hstack([t, np.frombuffer(b"".join(g), np.uint8).reshape(len(g), -1) / 255])
    known = quality.Rows(every[at], m[at], np.array([y for _, y in sample], float))
    left = {r["doc_id"] for r in labels.where("quality is not null").select("doc_id").collect()}
    rest = [i for i, d in enumerate(ids) if d not in left]
    assert rest and len(left) < len(named)
    model = quality.co_train(known, plain_hand_over([ids[i] for i in rest], t[rest], [g[i] for i in rest], m[rest]))
    want = dict(zip(ids, zip(*model.scores(every, m), strict=True), strict=True))
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(ids)
    for r in got:
        assert np.allclose((r["text_score"], r["meta_score"], r["score"]), want[r["doc_id"]], atol=1e-5), r
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = {r["doc_id"] for r in docs.where(held_out(docs.doc_id)).select("doc_id").collect()}
    assert {r["doc_id"] for r in got if r["held_out"]} == held


def test_the_exchange_helps_where_each_view_alone_is_poor():
    """The metadata tell the class of half the documents only; the text tells it weakly in many features, too many for few labels."""
    rng = np.random.default_rng(4)
    n, few = 3000, 40
    y = rng.integers(0, 2, n)
    sign = 2.0 * y[:, None] - 1
    t = rng.normal(size=(n, quality.SURFACE_DIMS)) + 0.25 * sign
    m = np.zeros((n, quality.META_DIMS))
    told = rng.random(n) < 0.5
    m[told, 0] = sign[told, 0] + 0.3 * rng.normal(size=told.sum())
    g = [bytes(quality.GRAM_DIMS)] * n
    x = np.hstack([t, np.zeros((n, quality.GRAM_DIMS))])
    known, new = quality.Rows(x[:few], m[:few], y[:few].astype(float)), slice(2000, n)
    hand_over = plain_hand_over(list(range(few, 2000)), t[few:2000], g[few:2000], m[few:2000])
    right = lambda scores: [float(((s[new] >= 0.5) == y[new]).mean()) for s in scores]
    alone, exchanged = (right(quality.co_train(known, hand_over, rounds).scores(x, m)) for rounds in (0, 60))
    assert alone[0] < 0.85 and alone[1] < 0.8, alone
    assert exchanged[0] > alone[0] + 0.03, (alone, exchanged)
    assert exchanged[2] > alone[2], (alone, exchanged)
