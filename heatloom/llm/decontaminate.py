"""Benchmark passages in documents: q-gram lemma over diagonal bands, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import file_system, kept, shared_dir, slices

#: Characters of a shared q-gram, and the share of an item's characters that may differ.
Q, ERROR_RATE = 10, 0.08
#: Benchmark characters that are searched for in one pass over the documents; their index takes some 0.5 GB while it is built.
BLOCK_CHARS = 1 << 23
#: Document characters that are looked through at once.
SLICE_CHARS = 1 << 20
#: Pairs of equal q-grams that are counted at once.
HITS = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 22
_LOW, _BAND_BITS = 1 << 25, 29  # keeps numbers of bands positive; bits of such a number
SPACE, WALL = 32, 0x110000
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return lower, np.array([c.isalnum() for c in chars])


_LOWER, _ALNUM = _tables()


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits with single spaces between, as code points; and where each stands in ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes & 0xFFFF
    alnum = np.where(codes < 1 << 16, _ALNUM[low], True)
    at = np.flatnonzero(alnum | np.r_[False, alnum[:-1]])
    out = np.where(alnum[at], np.where(codes[at] < 1 << 16, _LOWER[low[at]], codes[at]), SPACE).astype(np.uint32)
    while len(out) and out[-1] == SPACE:
        out, at = out[:-1], at[:-1]
    return out, at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` codes, put together from runs of powers of two."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run, size = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
        run ^= run >> np.uint64(32)
        out, done = None, 0
        while True:
            if q & size:
                power = np.uint64(pow(_BASE, size, 1 << 64))
                out = run if out is None else out[: len(run) - done] * power + run[done:]
                done += size
            if done == q:
                return out[: len(codes) - q + 1]
            run = run[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + run[size:]
            size *= 2


@dataclass(frozen=True)
class Item:
    item_id: int | None
    codes: np.ndarray
    budget: int
    shared: int  # q-grams that a region within the budget has in common with the item at least


def gram_length(size: int, q: int, error_rate: float) -> int:
    """The most characters, ``q`` at most, that q-grams of an item can have and still show all edits that it is allowed."""
    return max(1, min(q, size // (int(error_rate * size) + 1)))


class Postings:
    """Where the q-grams of some items stand, by hash."""

    def __init__(self, items: list[Item], numbers: list[int], q: int):
        self.q = q
        grams = [gram_hashes(i.codes, q) for i in items]
        sizes = [len(g) for g in grams]
        every = np.concatenate(grams)
        del grams
        order = np.argsort(every, kind="stable")
        every = every[order]
        self.first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]).astype(np.int32)
        self.hashes = every[self.first]
        self.count = np.diff(self.first, append=len(every)).astype(np.int32)
        del every
        self.owner = np.repeat(np.array(numbers, np.int32), sizes)[order]
        self.place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, posting) of the q-grams that ``codes`` shares, in slices of about ``HITS``."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        g = np.searchsorted(self.hashes, h[at])
        g[g == len(self.hashes)] = 0
        found = self.hashes[g] == h[at]
        at, g = at[found], g[found]
        ends = np.cumsum(self.count[g], dtype=np.int64)
        lo = 0
        while lo < len(at):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + HITS, "right")))
            n = self.count[g[lo:hi]]
            hit = np.repeat(np.arange(lo, hi), n)
            yield at[hit], self.first[g[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
            lo = hi


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``keys``, ascending, and how often each stands there."""
    if len(keys) and int(keys.max()) - (low := int(keys.min())) < 4 * len(keys):
        n = np.bincount(keys - low)
        found = np.flatnonzero(n)
        return found + low, n[found]
    return np.unique(keys, return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, summed over ``parts``."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


class Matcher:
    """Finds whole benchmark items in documents within their edit budgets."""

    def __init__(self, items: list[tuple[int | None, str | None]], q: int = Q, error_rate: float = ERROR_RATE):
        self.items, self.short = [], []
        by_length: dict[int, list[int]] = {}
        for item_id, text in items:
            codes, _ = normal(text or "")
            m = len(codes)
            budget = int(error_rate * m)
            if m >= q or budget:
                own = gram_length(m, q, error_rate)
                by_length.setdefault(own, []).append(len(self.items))
                self.items.append(Item(item_id, codes, budget, m + 1 - own * (budget + 1)))
            elif m:
                self.short.append((item_id, " " + "".join(map(chr, codes)) + " "))
        self.postings = [Postings([self.items[i] for i in numbers], numbers, n) for n, numbers in sorted(by_length.items())]
        self.width = np.array([i.budget + 1 for i in self.items], np.int64)
        self.shared = np.array([i.shared for i in self.items], np.int64)

    def _regions(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, band) that share enough q-grams; band b of an item covers a document's diagonals from b * width, two widths of them.

        Hits are counted slice by slice, so that memory follows the number of bands with hits, not of hits.
        """
        parts, held, docs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, len(bounds) - 1
        for postings in self.postings:
            for at, posting in postings.shared(codes):
                item, doc = postings.owner[posting].astype(np.int64), np.searchsorted(bounds, at, "right") - 1
                parts.append(counted((item * docs + doc << _BAND_BITS) + (at - bounds[doc] - postings.place[posting]) // self.width[item] + _LOW))
                held += len(parts[-1][0])
                if held > HITS:
                    parts = [added(parts)]
                    held = 0
        bands, counts = added(parts)
        if len(bands):
            # a band takes the hits of two neighbouring strips
            after = np.searchsorted(bands, bands + 1)
            after[after == len(bands)] = 0
            both = counts + np.where(bands[after] == bands + 1, counts[after], 0)
            before = np.setdiff1d(bands - 1, bands)
            alone = counts[np.searchsorted(bands, before + 1)]
            bands, both = np.concatenate([bands, before]), np.concatenate([both, alone])
            bands = bands[both >= self.shared[(bands >> _BAND_BITS) // docs]]
        pair = bands >> _BAND_BITS
        return pair // docs, pair % docs, (bands & ((1 << _BAND_BITS) - 1)) - _LOW

    @staticmethod
    def _align(pattern: np.ndarray, windows: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Edit distances of ``pattern`` to the text that ends at each diagonal, for many windows; ``windows[:, j:j+diagonals]`` meets pattern[j]."""
        diagonals = cost.shape[1]
        steps = np.arange(diagonals, dtype=np.int32)
        for j, c in enumerate(pattern):
            other = cost + (windows[:, j : j + diagonals] != c)
            np.minimum(other[:, :-1], cost[:, 1:] + 1, out=other[:, :-1])
            cost = np.minimum.accumulate(other - steps, axis=1) + steps
        return cost

    def _verify(self, item: Item, codes: np.ndarray, bands: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(number, start, end, edits) of each band's best alignment within its document ``codes[lo:hi]`` and the budget, relative to it."""
        k, m = item.budget, len(item.codes)
        diagonals = 4 * k + 2
        most = max(1, SLICE_CHARS // (diagonals + m))
        for a in range(0, len(bands), most):
            low, high = lo[a : a + most, None], hi[a : a + most, None]
            first = low + bands[a : a + most, None] * (k + 1) - k
            at = first + np.arange(diagonals - 1 + m)
            windows = np.where((at >= low) & (at < high), codes[np.clip(at, 0, len(codes) - 1)], np.uint32(WALL))
            ends = self._align(item.codes, windows, np.zeros((len(first), diagonals), np.int32))
            t = ends.argmin(1)
            edits = ends[np.arange(len(t)), t]
            ok = np.flatnonzero(edits <= k)
            if len(ok):
                anchored = np.full((len(ok), diagonals), 1 << 20, np.int32)
                anchored[np.arange(len(ok)), diagonals - 1 - t[ok]] = 0
                starts = diagonals - 1 - self._align(item.codes[::-1], windows[ok, ::-1], anchored).argmin(1)
                start = np.maximum(first[ok, 0] + starts, low[ok, 0])
                end = np.minimum(first[ok, 0] + t[ok] + m, high[ok, 0])
                start, end = start - low[ok, 0], end - low[ok, 0]
                yield from ((a + int(i), int(s), int(e), int(n)) for i, s, e, n in zip(ok, start, end, edits[ok], strict=True) if s < e)

    def find(self, texts: list[str]) -> Iterator[list[tuple[int | None, int, int, int]]]:
        """For each text its (item_id, start, end, edits), in code points of the text."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SLICE_CHARS and upto - at < 4096):
                size += len(texts[upto])
                upto += 1
            parts = [normal(t) for t in texts[at:upto]]
            wall = np.array([WALL], np.uint32)
            codes = np.concatenate([x for c, _ in parts for x in (c, wall)])
            bounds = np.cumsum([0] + [len(c) + 1 for c, _ in parts])
            found: list[set] = [set() for _ in parts]
            number, doc, band = self._regions(codes, bounds) if self.items else (np.zeros(0, np.int64),) * 3
            order = np.argsort(number, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
                item, in_doc = self.items[number[own[0]]], doc[own]
                for n, *hit in self._verify(item, codes, band[own], bounds[in_doc], bounds[in_doc + 1] - 1):
                    found[in_doc[n]].add((item.item_id, *hit))
            for d, (c, _) in enumerate(parts if self.short else []):
                text = " " + "".join(map(chr, c.tolist())) + " "
                for item_id, mark in self.short:
                    p = text.find(mark)
                    while p >= 0:
                        found[d].add((item_id, p, p + len(mark) - 2, 0))
                        p = text.find(mark, p + 1)
            for d, (_, where) in enumerate(parts):
                yield sorted(((i, int(where[s]), int(where[min(e, len(where)) - 1]) + 1, n) for i, s, e, n in self._best(found[d])), key=lambda x: (x[1:], x[0] is not None, x[0]))
            at = upto

    @staticmethod
    def _best(hits: set) -> list:
        """Of overlapping places of one item the one with the fewest edits, the first of several."""
        out: list = []
        taken: dict[int | None, list[tuple[int, int]]] = {}
        for hit in sorted(hits, key=lambda x: (x[3], x[1], x[2], str(x[0]))):
            places, place = taken.setdefault(hit[0], []), (hit[1], hit[2])
            i = bisect(places, place)
            if (not i or places[i - 1][1] <= hit[1]) and (i == len(places) or hit[2] <= places[i][0]):
                places.insert(i, place)
                out.append(hit)
        return out


@dataclass(frozen=True)
class Benchmark:
    """Items in files of the shared folder, in blocks that fit a task's memory; neither the driver nor a closure holds them."""

    folder: str
    blocks: int

    @classmethod
    def of(cls, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Benchmark:
        items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
        blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
        folder = shared_dir(benchmark.sparkSession)
        items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).write.partitionBy("block").parquet(folder)
        return cls(folder, blocks)

    def items(self, block: int) -> list[tuple[int | None, str]]:
        """The items of a block, in a task."""
        store, path = file_system(f"{self.folder}/block={block}")
        files = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        rows = [r for f in files if f.path.endswith(".parquet") for r in pq.read_table(f.path, filesystem=store, partitioning=None).to_pylist()]
        return sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1]))


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits: where documents hold a whole benchmark item.

    Case, punctuation and white space don't count. An item of m characters may differ in
    ``error_rate`` * m of them; where q-grams of ``q`` characters can't show so many edits, shorter ones are
    counted. Regions are diagonal bands that share as many q-grams with the item as the lemma asks for;
    banded alignment then settles them; of overlapping places of an item the one with the fewest edits counts. Items of
    fewer than q characters that may not differ at all (none may at the default rate) match as whole words;
    items without letters or digits match nothing. Documents are read where they lie, one task per input
    split, and never move; each block of the benchmark takes a pass over them.

    Null and empty texts have no rows; texts of any length are read whole, in memory that follows their length. Repeated rows
    and ids have rows each, ids may be null, equal items of other ids are items of their own; other columns are
    ignored; an empty table or benchmark gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bench = Benchmark.of(benchmark, item_col, item_text)

    def passed(block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = f"{bench.folder} {block}"
            matcher = kept(key, lambda: Matcher(bench.items(block), q, error_rate))  # a worker builds it once
            for batch in slices(batches, keep=key):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [(i, *hit) for i, hits in zip(ids, matcher.find(texts), strict=True) for hit in hits]
                if out:
                    a, b, c, d, e = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (a, b, c, d)], pa.array(e, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])

        return rows.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.union, map(passed, range(bench.blocks)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose texts hold a benchmark item, as ``contaminated_regions`` finds them; columns stay as they are.

    Each row is judged by its own text, so repeated rows and ids go or stay by it; null and empty texts hold nothing
    and stay. Other columns may have any names. An empty benchmark lets all rows stay, an empty table gives none.
    """
    where, bench = docs.columns.index(text_col), Benchmark.of(benchmark, item_col, item_text)

    def cleared(rows: DataFrame, block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = f"{bench.folder} {block}"
            matcher = kept(key, lambda: Matcher(bench.items(block), q, error_rate))
            for batch in slices(batches, keep=key):
                texts = [t or "" for t in batch.column(where).to_pylist()]
                yield batch.filter(pa.array([not hits for hits in matcher.find(texts)], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return reduce(cleared, range(bench.blocks), docs)
