"""Features of texts."""

import unicodedata

import numpy as np

from heatloom.sources.points import document_points


def test_features_of_odd_texts(spark, tmp_path):
    """letters are taken out by runs, once; the counts are those of single characters."""
    texts = [None, "", "   ", "Ab C1Éé \U0001d400x中", "ǅ ß\n\tZ!", "1234"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["row_id"]: r["x"] for r in document_points(spark, str(tmp_path)).collect()}
    kinds = [[unicodedata.category(c) for c in t or ""] for t in texts]
    for place, kind in ((2, "L"), (3, "Lu")):
        raw = np.array([sum(c.startswith(kind) for c in k) / (len(k) + 1) for k in kinds])
        np.testing.assert_allclose([got[i][place] for i in range(len(texts))], (raw - raw.mean()) / raw.std(ddof=1) / 5**0.5, atol=1e-12)
