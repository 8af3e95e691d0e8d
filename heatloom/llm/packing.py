"""Token packing by minimum bin slack over a histogram of piece lengths."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import slices, written

#: Entries of a worker's word cache, after which it starts anew.
CACHE_WORDS = 300_000
#: Characters whose normal form, lower case and class are alike in Python and in the tokenizer: all but these.
RARE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ]")
#: The tokenizer's words, for text that is in lower case and has no rare characters.
WORDS = re.compile(r"[a-zªµºß-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|\d|[^\sa-z\dªµºß-öø-ſ]+")


#: The steps before the model of tokenizers whose words can be told apart by ``WORDS``.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


class TokenBytes:
    """Little-endian unsigned 32-bit ids of whole texts, as the tokenizer file gives them.

    Where the file lower-cases, splits words as ``WORDS`` does and marks each word's last id, unknown words are encoded
    as one text and cut at those ids, and ids are kept by word. Texts with rare characters or special-token marks, and
    all texts of any other tokenizer, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        alike = file["normalizer"] == NORMALIZER and steps[0].get("pattern") == SPLITTER and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        plain = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        marked = file["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in file["added_tokens"])
        self.by_word = bool(alike and plain and marked and not file["post_processor"])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = self._encode(" ".join(part))
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) != len(part) or ends[-1] != len(raw):
                raise ValueError("the tokenizer doesn't mark the ends of words")
            self.words.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 32):
            block = texts[at : at + 32]
            split = [None if not self.by_word or RARE.search(t) or "<|" in t else WORDS.findall(t.lower()) for t in block]
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            known = self.words
            new = set().union(*filter(None, split)).difference(known)
            if new:
                self._learn(list(new))
            get = known.__getitem__
            for text, words in zip(block, split, strict=True):
                yield self._encode(text).tobytes() if words is None else b"".join(map(get, words))


def best_fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of ``counts`` (length: how many) whose sum is closest to ``room`` from below.

    Reachable sums are the bits of one integer; a length's count is taken in powers of two, so each
    step is a shift and an or. The steps are kept and walked back for the counts.
    """
    full, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            take = min(chunk, left)
            steps.append((length, take, sums))
            sums |= (sums << length * take) & full
            left, chunk = left - take, chunk * 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many)]) that use up ``counts``: each bin takes the longest length left and its best fill.

    A pattern is used as often as its lengths allow, so their number depends on the capacity, not on
    the number of pieces.
    """
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        fill = dict(best_fill({k: v for k, v in counts.items() if v and k <= capacity - top}, capacity - top))
        counts[top] += 1
        fill[top] = fill.get(top, 0) + 1
        times = min(counts[k] // v for k, v in fill.items())
        out.append((times, sorted(fill.items(), reverse=True)))
        for k, v in fill.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full ones of ``capacity`` ids and a rest; with part and rank, the piece's place among its length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seen = TokenBytes(tokenizer), TaskContext.get().partitionId(), {}
        tail = end_id.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokens([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = memoryview(ids + tail)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rank = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, rank))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids, each document followed by ``end_id``.

    Documents are cut at every ``capacity`` ids. The histogram of piece lengths (at most ``capacity``
    rows) goes to the driver, where minimum bin slack turns it into bin patterns with counts;
    the n-th piece of a length finds its bin and offset by its rank alone.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0), offset. A null or empty
    text is the end id alone. Repeated rows are packed each; ids may be null. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    taken: dict[int, int] = {}
    plan, sequence = [], 0
    for times, items in bin_patterns(counts, capacity):
        offset = 0
        for length, each in items:
            first = taken.get(length, 0)
            plan.append(Row(of=length, first=first, last=first + each * times, each=each, sequence=sequence, at=offset))
            taken[length] = first + each * times
            offset += length * each
        sequence += times
    places = spark.createDataFrame(plan, "of long, first long, last long, each long, sequence long, at long")
    places = places.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("last", "first", "each", "sequence", "at"))).alias("places"))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.join(F.broadcast(places), F.col("length") == F.col("of"))  # a row per length
    ranked = ranked.withColumn("p", F.expr("filter(places, p -> p.last > rank)[0]"))
    nth = F.col("rank") - F.col("p.first")
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p.sequence") + F.floor(nth / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.at") + F.col("length") * (nth % F.col("p.each"))).cast("long").alias("offset"),
    )
