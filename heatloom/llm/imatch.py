"""I-Match fingerprints: terms of a document-frequency band, hashed over randomised subsets of the lexicon."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import slices

#: The band, as shares of all documents: idf between log(1/HIGH) and log(1/LOW).
LOW, HIGH = 0.002, 0.1
#: Each scale keeps this share of the lexicon in each of its subsets.
SHARES, SUBSETS = (1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024), 24
#: Subsets of a scale that must be filled for it to tell two texts apart.
FILLED = 9
DIGITS = 6
EMPTY = "0" * DIGITS
#: Terms that a task counts before it passes them on.
COUNTED = 200_000


_TERM = re.compile(r"[^\W_]+")


def terms_of(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many of all documents each term stands; counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return b

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(terms_of(text or ""))
                if len(seen) > COUNTED:
                    yield out()
        if seen:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def band_lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[str]:
    """The terms that stand in at least ``low`` and at most ``high`` of all documents.

    Their number is bounded whatever the corpus: as many documents' terms as there are, at most the
    mean number of distinct terms of a document divided by ``low``.
    """
    n = docs.count()
    found = document_frequency(docs, text_col).where((F.col("n") >= max(low * n, 2)) & (F.col("n") <= max(high * n, 2)))
    return [r["term"] for r in found.select("term").collect()]


class Fingerprinter:
    """Fingerprints by one lexicon: for each scale and subset, a hash of the sorted terms in it."""

    def __init__(self, lexicon: list[str], shares: tuple[float, ...] = SHARES, subsets: int = SUBSETS):
        self.subsets, self.scales = subsets, len(shares)
        lexicon = sorted(lexicon)
        self.number = {t: i for i, t in enumerate(lexicon)}
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in lexicon], np.uint64)
        #: which terms each subset keeps, by a hash of the term and the subset's number alone
        self.kept = self._kept(self.hashes, shares)
        self.shares = shares

    def _kept(self, hashes: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
        rows = []
        with np.errstate(over="ignore"):
            for k in range(len(shares) * self.subsets):
                x = (hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(31)
                x *= np.uint64(0x94D049BB133111EB)
                rows.append((x >> np.uint64(11)).astype(np.float64) / (1 << 53) < shares[k // self.subsets])
        return np.array(rows, bool)

    def __call__(self, text: str) -> str:
        terms = terms_of(text)
        known = self.number
        ids = np.array(sorted(known[t] for t in terms if t in known), np.int64)
        if len(ids):
            hashes, kept = self.hashes[ids], self.kept[:, ids]
        elif terms:  # nothing in the band: all terms stand in
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in sorted(terms)], np.uint64)
            kept = self._kept(hashes, self.shares)
        else:
            return EMPTY * (self.scales * self.subsets)
        rows, cols = np.nonzero(kept)
        ends = np.cumsum(np.bincount(rows, minlength=len(kept)))
        picked = hashes[cols].tobytes()
        out, start = [], 0
        for end in ends.tolist():
            out.append(f"{xxhash.xxh64_intdigest(picked[8 * start : 8 * end]) % (16**DIGITS - 1) + 1:06x}" if end > start else EMPTY)
            start = end
        return "".join(out)

    def likeness(self, a: str, b: str) -> float:
        """Share of equal hashes among the filled ones, at the finest scale that fills enough; 1 for equal fingerprints."""
        if a == b:
            return 1.0
        step = DIGITS * self.subsets
        for scale in reversed(range(self.scales)):
            x, y = a[scale * step : (scale + 1) * step], b[scale * step : (scale + 1) * step]
            pairs = [(x[i : i + DIGITS], y[i : i + DIGITS]) for i in range(0, step, DIGITS)]
            filled = sum(p != EMPTY or q != EMPTY for p, q in pairs)
            if filled >= FILLED or scale == 0:
                return sum(p == q != EMPTY for p, q in pairs) / filled if filled else 0.0
        return 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def range_bounds(ids: DataFrame, n: int) -> np.ndarray:
    """At most ``n - 1`` ascending cut points that split the one column of ``ids`` into ranges of similar row counts."""
    row = ids.agg(F.percentile_approx(ids.columns[0], [i / n for i in range(1, n)], max(1000, 2 * n))).first()
    return np.array(sorted(set(row[0] or [])), np.int64)


def ranged(column: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, nulls as the least number, and the range of each: how many of ``bounds`` are at most the id."""
    ids = column.fill_null(-(1 << 63)).to_numpy()
    return ids, np.searchsorted(bounds, ids, "right").astype(np.int32)


def range_firsts(ids: DataFrame, bounds: np.ndarray) -> dict[int, int]:
    """The largest id of each range that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.iinfo(np.int64).min
        most, seen = np.full(len(bounds) + 1, low), np.zeros(len(bounds) + 1, bool)
        for batch in batches:
            own, bucket = ranged(batch.column(0), bounds)
            np.maximum.at(most, bucket, own)
            seen[bucket] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(most[at])], names=["bucket", "first"])

    found = ids.mapInArrow(run, "bucket int, first long").groupBy("bucket").agg(F.max("first").alias("first"))
    return {r["bucket"]: r["first"] for r in found.collect()}  # a row per range


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, copy, doc_id and body (the text in Zstandard), dealt and sorted so that each row's next in descending id order follows it.

    Ids are cut into ranges of similar size, a partition each. A range's first document is also put, as a copy, at the
    end of the range before it; the first of all, at the end of the last. Texts move once, compressed.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = range_bounds(ids, n)
    firsts = sorted(range_firsts(ids, bounds).items(), reverse=True)
    goes_to = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    heads = np.array(sorted(goes_to), np.int64)
    targets = np.array([goes_to[h] for h in heads.tolist()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            own, bucket = ranged(batch.column(0), bounds)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            ties = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            rows = np.arange(len(own))
            at = np.searchsorted(heads, own)
            again = rows[(at < len(heads)) & (heads[np.minimum(at, len(heads) - 1)] == own)] if len(heads) else rows[:0]
            bucket = np.concatenate([bucket, targets[at[again]]])
            copy, rows = np.repeat(np.array([0, 1], np.int32), [len(rows), len(again)]), np.concatenate([rows, again])
            bodies = [squeeze.compress(r) for r in raw]
            arrays = [pa.array(bucket), pa.array(copy), batch.column(0).take(pa.array(rows)), pa.array(ties[rows]), pa.array([bodies[i] for i in rows.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "copy", "doc_id", "tie", "body"])

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "bucket int, copy int, doc_id long, tie long, body binary")
    return dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), "tie").drop("tie")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are.

    Document frequencies are counted over all documents. The next document is that of the next lower id
    (of equal ids, the next text by XXH64; null ids come last), and after the last the first.
    A null text is empty. A text with no term in the band is hashed by all its terms, one without
    terms has the fingerprint of zeros. Repeated rows get a row each. An empty table gives no rows;
    other columns are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(band_lexicon(docs, text_col, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, unpack = Fingerprinter(lexicon.value), zstandard.ZstdDecompressor()
        held: tuple | None = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in slices(batches):
            out = []
            for bucket, copy, doc, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = unpack.decompress(body).decode("utf-8", "surrogatepass")
                own = mark(text)
                if held and held[0] == bucket:
                    _, last_copy, last_doc, last_text, last_own = held
                    if not last_copy:
                        new = edited(last_text, text)
                        new_mark = mark(new)
                        out.append((last_doc, len(last_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last_own, new_mark, mark.likeness(last_own, new_mark), mark.likeness(last_own, own)))
                held = bucket, copy, doc, text, own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
