"""Repeated byte strings by suffix arrays: strings are dealt to shards by content, each shard is sorted, and shards are merged by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import slices, written

#: Bytes of a string whose repetition counts, and of the part of it that decides its shard.
LENGTH, GRAM = 400, 128
#: Bytes of a shard (three numbers below it fit 63 bits), and starts of neighbouring strings that stay together.
SHARD, STARTS = 1 << 20, 1024
#: Different passages of one key beyond which its strings are dealt by their whole content instead.
HOT = 512
#: Bytes hashed at once, and text segments that Kasai's scan follows side by side.
BLOCK, LANES = 1 << 20, 4096

_rng = np.random.default_rng(11)
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
_TIMES, _OTHER = (int(x) | 1 for x in _rng.integers(0, 1 << 64, 2, np.uint64))


def hashes(data: np.ndarray, size: int, factor: int = _TIMES) -> np.ndarray:
    """Polynomial hashes, mixed, of all strings of ``size`` bytes of ``data``; put together from those of powers of two."""
    level, width, out, done = _BYTES[data], 1, None, 0
    shifted = lambda a, by: a * np.uint64(pow(factor, by, 1 << 64))
    while True:
        if size & width:
            out = level if out is None else shifted(level[: len(level) - done], done) + out[width:] if done else level
            done += width
        if width * 2 > size:
            break
        level, width = shifted(level[:-width], width) + level[width:], width * 2
    out = out[: len(data) - size + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(_OTHER)
    return out ^ (out >> np.uint64(29))


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    step = 1
    while step * 2 <= width:
        values, step = np.minimum(values[:-step], values[step:]), step * 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def passages(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every string of ``length`` bytes inside a text its key, the least hash of its parts of ``gram`` bytes; neighbours of one key come as one passage.

    Yields arrays of text number, key, first start, number of starts, a digest of the passage's bytes, and whether its key's
    part has more than one place among the bytes hashed at once, without which the passage can't repeat a string of its own.
    """
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for at in range(0, len(data) - length + 1, BLOCK):
        piece = data[at : at + BLOCK + length - 1]
        part = hashes(piece, gram)
        key = minima(part, length - gram + 1)
        start = at + np.arange(len(key))
        text = np.searchsorted(ends, start, "right")
        ok = np.flatnonzero(start + length <= ends[text])
        if not len(ok):
            continue
        key, start, text = key[ok], start[ok], text[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1] + 1)
        first = np.flatnonzero(new)
        long = np.diff(np.append(first, len(ok)))
        if long.max() > STARTS:
            pieces = -(-long // STARTS)
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, long = np.repeat(first, pieces) + STARTS * within, np.minimum(np.repeat(long, pieces) - STARTS * within, STARTS)
        begins = start[first]
        digest = [xxhash.xxh3_64_intdigest(joined[b : b + n + length - 1]) for b, n in zip(begins.tolist(), long.tolist(), strict=True)]
        number, own = text[first], key[first]
        part = np.sort(part[part <= own.max()])
        several = np.unique(part[1:][part[1:] == part[:-1]])
        yield number, own.view(np.int64), begins - np.append(0, ends)[number], long, np.array(digest, np.uint64).view(np.int64), np.isin(own, several)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order: Larsson and Sadakane's refinement, whose rounds sort only what isn't told apart yet.

    A round sorts by (group, group of the suffix ``h`` further on, start) as one number.
    """
    n = len(data)
    bits, pad = n.bit_length(), 4
    if 3 * bits > 63:
        raise ValueError("a shard must be below 2^21 bytes")
    low = (1 << bits) - 1
    wide = np.zeros(n + pad, np.int64)
    wide[:n] = data.astype(np.int64) + 1
    key = wide[:n].copy()
    for j in range(1, pad + 1):
        key = key * 257 + wide[j : j + n]
    s = np.sort(key << bits | np.arange(n))
    order, where, h = s & low, np.arange(n), pad + 1
    group = np.zeros(n + 1, np.int64)  # a group's number is the place of its last member, counted from 1; 0 beyond the end
    told = s >> bits
    while len(where):
        last = np.ones(len(where), bool)
        last[:-1] = told[1:] != told[:-1]
        ends = np.flatnonzero(last)
        size = np.diff(np.append(-1, ends))
        group[order[where]] = np.repeat(where[ends] + 1, size)
        where = where[np.repeat(size > 1, size)]
        if not len(where):
            break
        p = order[where]
        s = np.sort((group[p] << bits | group[np.minimum(p + h, n)]) << bits | p)
        order[where], told, h = s & low, s >> bits, 2 * h
    return order


def words_of(data: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros beyond the end, ``more`` places of them."""
    wide = np.zeros(len(data) + more + 8, np.uint8)
    wide[: len(data)] = data
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(">u8")[:, 0].astype(np.uint64)


def common(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes, up to ``most``, from ``at`` in the words ``a`` and from ``to`` in ``b``, of which ``known`` are known to be equal."""
    h = known.copy()
    live = np.flatnonzero(h < most)
    while len(live):
        x = a[at[live] + h[live]] ^ b[to[live] + h[live]]
        same, more = x == 0, np.zeros(len(x), np.int64)
        for shift in (32, 16, 8):
            small = x < np.uint64(1 << (64 - shift))
            more += np.where(small, shift // 8, 0)
            x = np.where(small, x << np.uint64(shift), x)
        h[live] += np.where(same, 8, more)
        live = live[same & (h[live] < most)]
    return np.minimum(h, most)


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Equal first bytes of each suffix and the one before it in order, up to ``most``: Kasai's scan in text order, many segments side by side."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    step = -(-n // LANES)
    base = np.arange(0, n, step)
    h = np.zeros(len(base), np.int64)
    for t in range(step):
        p = base + t
        p = p[p < n]
        r = rank[p]
        q = order[np.maximum(r - 1, 0)]
        room = n - np.maximum(p, q)
        got = np.minimum(common(words, words, p, q, np.maximum(h[: len(p)] - 1, 0), most), room)
        got[r == 0] = 0
        out[r] = got
        h = got
    return out


class Shard:
    """Passages of ascending keys, their sorted suffixes, and how often the string at each place occurs."""

    def __init__(self, keys: list, texts: list[bytes], starts: list[int], weights: list[int], rows: list, length: int):
        self.keys, self.rows, self.starts, self.length = keys, rows, starts, length
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.begins = np.cumsum(sizes) - sizes
        self.words = words_of(data, length)
        self.order = suffix_order(data)
        shared = common_prefixes(self.words, self.order, length)
        #: equal strings have one class, by suffix order
        self.cls = np.empty(len(data), np.int64)
        self.cls[self.order] = np.cumsum(shared < length) - 1
        row = np.repeat(np.arange(len(texts)), sizes)
        self.inside = np.arange(len(data)) - self.begins[row] < np.array(starts)[row]  # the others reach into the next passage
        weight = np.where(self.inside, np.array(weights)[row], 0)
        self.own = np.bincount(self.cls, weight).astype(np.int64)
        self.count = self.own.copy()

    def find(self, other: Shard, places: np.ndarray) -> np.ndarray:
        """By binary search, a place of this shard that has the same string as each of ``places`` of ``other``, or -1."""
        n = len(self.order)
        low, high = np.zeros(len(places), np.int64), np.full(len(places), n)
        found = np.full(len(places), -1)
        zero = np.zeros(len(places), np.int64)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            p, q = self.order[mid], places[live]
            same = np.minimum(common(self.words, other.words, p, q, zero[live], self.length), n - p)
            hit = same >= self.length
            found[live[hit]] = p[hit]
            at = np.minimum(same, self.length - 1)
            less = (p + same >= n) | (self.words[p + at] >> np.uint64(56) < other.words[q + at] >> np.uint64(56))
            low[live] = np.where(hit, high[live], np.where(less, mid + 1, low[live]))
            high[live] = np.where(hit | less, high[live], mid)
        return found

    def merge(self, other: Shard, key: int) -> None:
        """Counts the strings of ``key`` that both shards have in both."""
        first = next(i for i, k in enumerate(other.keys) if k == key)
        last = len(other.keys) - next(i for i, k in enumerate(reversed(other.keys)) if k == key)
        to = other.begins[last] if last < len(other.keys) else len(other.order)
        places = np.arange(other.begins[first], to)
        places = places[other.inside[places]]
        _, one = np.unique(other.cls[places], return_index=True)
        places = places[one]
        found = self.find(other, places)
        hit = found >= 0
        mine, its = self.cls[found[hit]], other.cls[places[hit]]
        self.count[mine] += other.own[its]
        other.count[its] += self.own[mine]

    def repeated(self) -> Iterator[tuple]:
        """Of each row that has any its columns and the ranges of starts whose strings occur more than once."""
        often = self.inside & (self.count[self.cls] >= 2)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
        lows, highs = edge[::2], edge[1::2]
        row = np.searchsorted(self.begins, lows, "right") - 1
        for i in np.unique(row).tolist():
            own = row == i
            yield *self.rows[i], [{"lo": a, "hi": b} for a, b in zip((lows[own] - self.begins[i]).tolist(), (highs[own] - self.begins[i]).tolist(), strict=True)]


def shards_settled(rows: Iterator[tuple], length: int, shard: int = SHARD) -> Iterator[tuple]:
    """Cuts (key, text, starts, weight, columns), ascending by key, into shards and gives the columns and repeated ranges of rows.

    A key whose passages lie in several shards keeps these open until they have been merged with each other.
    """
    held: tuple[list, ...] = ([], [], [], [], [])
    size, waiting = 0, []

    def close() -> Iterator[tuple]:
        nonlocal waiting, size
        new = Shard(*(list(h) for h in held), length)
        for h in held:
            h.clear()
        size = 0
        key = new.keys[0]
        if waiting and waiting[-1].keys[-1] == key:
            for old in waiting:
                old.merge(new, key)
            if new.keys[-1] == key:
                waiting.append(new)
                return
        for old in waiting:
            yield from old.repeated()
        waiting = [new]

    for key, text, starts, weight, columns in rows:
        if size and size + len(text) > shard:
            yield from close()
        for h, v in zip(held, (key, text, starts, weight, columns), strict=True):
            h.append(v)
        size += len(text)
    if size:
        yield from close()
    for old in waiting:
        yield from old.repeated()


_MARKS = "key long, digest long, starts int, marks array<struct<lo:int,hi:int>>"
_ARROW_MARKS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id and body: the texts in Zstandard, each row with a number of its own."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            bodies = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["doc_id", "body"])

    bodies = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, body binary")
    return written(bodies.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "body"))


def keyed(base: DataFrame, length: int, gram: int) -> DataFrame:
    """(uid, key, start, starts, digest, again): the passages of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            uid = batch.column(0).to_numpy()
            texts = [unpack.decompress(b) for b in batch.column(1).to_pylist()]
            for number, key, start, starts, digest, again in passages(texts, length, gram):
                arrays = [pa.array(uid[number]), pa.array(key), pa.array(start.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(digest), pa.array(again)]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "key", "start", "starts", "digest", "again"])

    return base.select("uid", "body").mapInArrow(run, "uid long, key long, start int, starts int, digest long, again boolean")


def fetched(base: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The rows of ``wanted`` (uid, start, key, digest, starts, weight, hot) with the passage's bytes as ``text``."""
    names = ["key", "digest", "starts", "weight", "hot"]
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("start", *names)).alias("w"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            bodies = batch.column(0).to_pylist()
            w = batch.column(1)
            counts, flat = w.value_lengths().to_pylist(), w.flatten()
            start, starts = flat.field(0).to_pylist(), flat.field(3).to_pylist()
            out, at = [], 0
            for body, n in zip(bodies, counts, strict=True):
                text = unpack.decompress(body)
                out += [text[start[i] : start[i] + starts[i] + length - 1] for i in range(at, at + n)]
                at += n
            yield pa.RecordBatch.from_arrays([*(flat.field(j + 1) for j in range(5)), pa.array(out, pa.binary())], names=[*names, "text"])

    return base.select("uid", "body").join(lists, "uid").select("body", "w").mapInArrow(run, "key long, digest long, starts int, weight long, hot boolean, text binary")


def marked(passage: DataFrame, length: int, shard: int) -> DataFrame:
    """Key, digest, starts and marks, the ranges of repeated starts, of passages that lie with all others of their key in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches, 256):
                for key, digest, starts, weight, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    yield key, text, starts, weight, (key, digest, starts)

        out: list = []

        def flushed() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), _ARROW_MARKS), strict=True)], names=["key", "digest", "starts", "marks"])
            out.clear()
            return b

        for found in shards_settled(rows(), length, shard):
            out.append(found)
            if len(out) >= 2048:
                yield flushed()
        if out:
            yield flushed()

    dealt = passage.select("key", "digest", "starts", "weight", "text").repartition("key").sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(run, _MARKS)


def marked_by_string(passage: DataFrame, length: int) -> DataFrame:
    """As ``marked``, for keys of too many passages: strings are dealt by two hashes of their whole content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            starts = batch.column(2).to_numpy()
            data = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8)
            at = np.cumsum(starts + length - 1) - (starts + length - 1)
            row = np.repeat(np.arange(len(starts)), starts)
            within = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            place = at[row] + within
            arrays = [*(pa.array(hashes(data, length, f)[place].view(np.int64)) for f in (_TIMES, _OTHER)), *(batch.column(i).take(pa.array(row)) for i in range(4)), pa.array(within.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "key", "digest", "starts", "weight", "lo"])

    strings = written(passage.select("key", "digest", "starts", "weight", "text").mapInArrow(run, "h1 long, h2 long, key long, digest long, starts int, weight long, lo int"))
    often = strings.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n >= 2").drop("n")
    places = strings.join(often, ["h1", "h2"])
    return places.groupBy("key", "digest", "starts").agg(F.collect_list(F.struct("lo", (F.col("lo") + 1).alias("hi"))).alias("marks"))


def removed(body: bytes, found: list | None, length: int) -> tuple[int, list, bytes]:
    """The bytes of a text, its maximal runs inside repeated strings, and what is left."""
    spans: list[list[int]] = []
    for lo, hi in sorted((p["start"] + m["lo"], p["start"] + m["hi"] + length - 1) for p in found or () for m in p["marks"]):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    edges = [0, *(x for s in spans for x in s), len(body)]
    return len(body), [{"start": a, "end": b} for a, b in spans], b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, shard: int = SHARD, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte that lies in a string of ``length`` bytes which also starts somewhere else, in the same document or another.

    Strings are judged on the input and matches stay inside documents; all copies go, the first as well. The key of a string is
    the least hash of its parts of ``gram`` bytes, so that equal strings have equal keys; neighbours of equal keys form one
    passage, about one for each 140 bytes. Only keys that occur twice go on (or whose
    passage may repeat itself), and equal passages as one with their
    number. Their bytes are dealt by key to partitions, cut into shards of ``shard`` bytes, each sorted as a suffix array;
    neighbours that share ``length`` bytes are equal strings. Shards that a key spans are merged by binary search. So shards
    are compared only where they can share a string, not each with each. A key of more than ``hot`` different
    passages (a common part in many contexts) is dealt by two hashes of whole strings instead, where equal ones are counted.

    Returns doc_id, n_bytes, spans (maximal removed runs of bytes: start, end exclusive) and kept (the other bytes,
    which may cut a character). Null texts are empty, texts below ``length`` bytes stay whole. Repeated rows, also of equal or null ids, are
    copies of each other. An empty table gives no rows; other columns are ignored. Any text that fits a row is taken whole.
    """
    gram = gram or max(1, length * GRAM // LENGTH)
    base = stored(docs, id_col, text_col)
    found = written(keyed(base, length, gram))
    twice = found.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("inside")).where("n >= 2 or inside").select("key")
    found = written(found.drop("again").join(twice, "key", "left_semi"))
    one = found.groupBy("key", "digest", "starts").agg(F.count("*").alias("weight"), F.min(F.struct("uid", "start")).alias("at"))
    one = written(one.select("key", "digest", "starts", "weight", "at.uid", "at.start"))
    crowded = one.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    wanted = one.join(crowded, "key", "left").na.fill(False, ["hot"])
    passage = written(fetched(base, wanted, length))
    marks = marked(passage.where("not hot"), length, shard)
    if not passage.where("hot").isEmpty():
        marks = marks.unionByName(marked_by_string(passage.where("hot"), length))
    marks = written(marks)
    spans = found.join(marks, ["key", "digest", "starts"]).groupBy("uid").agg(F.collect_list(F.struct("start", "marks")).alias("found"))  # of one text
    kind = base.schema["doc_id"].dataType.simpleString()
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            n, cut, left = zip(*(removed(unpack.decompress(b), f, length) for b, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(cut, arrow_spans), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "spans", "kept"])

    return base.join(spans, "uid", "left").select("doc_id", "body", "found").mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
