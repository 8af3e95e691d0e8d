"""SimHash fingerprints, a binary-trie self-join within a Hamming budget, and its connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import flagged, sent, slices, tasks_for, unused, written

SEED = 42
#: Rows, and pairs of trie nodes, that are held at once.
SLICE, PAIRS = 1 << 17, 1 << 16
#: Rows of a group that a task takes at most before the group is cut into cells, and rows of a task in the mean.
CELL, TASK_ROWS = 1 << 17, 50_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of ``text``'s word shingles, repeats counted; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest, seed = b" ".join(words), xxhash.xxh64_intdigest, SEED
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Components of rows under links that come in slices."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.version = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            self.version += 1
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up


@dataclass(frozen=True)
class Part:
    """Some words of all keys, the first one the most significant, of ``bits`` bits each, and how many of them may differ in all."""

    words: tuple[np.ndarray, ...]
    bits: int
    budget: int


def near_pairs(parts: list[Part], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows that are within the budget of every part."""
    for part in parts:
        differ = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in part.words)
        ok = differ <= part.budget
        a, b = a[ok], b[ok]
    return a, b


def trie_components(groups: np.ndarray, parts: list[Part]) -> np.ndarray:
    """The component of each row, under links between rows of one group that are within the budget of every part.

    Rows are sorted by group and by their words. A node of a group's binary trie is a run of rows with the same
    leading bits. Pairs of nodes are traversed together, level by level, from a group's root with
    itself; each step splits both nodes at the next bit and adds a differing bit for unlike
    branches; pairs over the part's budget are pruned, as are pairs whose rows are all of one component
    already. The trie is path-compressed: of two nodes that are single rows the other bits are counted at once.
    """
    n = len(groups)
    forest = Forest(n)
    if n < 2:
        return forest.label
    i = np.flatnonzero(groups[1:] == groups[:-1])
    forest.link(*near_pairs(parts, i, i + 1))
    levels = [(p, w, b) for p, part in enumerate(parts) for w in range(len(part.words)) for b in reversed(range(part.bits))]
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    edges = np.stack([edges[:-1], edges[1:]])
    edges = edges[:, edges[1] - edges[0] > 1]
    stack = [(0, np.concatenate([edges, edges, np.zeros((1, edges.shape[1]), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    changes, version = np.zeros(n, np.int64), -1
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > PAIRS:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
            continue
        if version != forest.version:
            changes, version = np.r_[0, np.cumsum(forest.label[1:] != forest.label[:-1])], forest.version
        lo, hi, lo2, hi2, _ = pairs
        same = (forest.label[lo] == forest.label[lo2]) & (changes[hi - 1] == changes[lo]) & (changes[hi2 - 1] == changes[lo2])
        pairs = pairs[:, ~same & ~((lo == lo2) & (hi - lo == 1))]
        lo, hi, lo2, hi2, _ = pairs
        if depth == len(levels):  # equal rows on either side, linked among themselves
            forest.link(lo, lo2)
            continue
        single = (hi - lo == 1) & (hi2 - lo2 == 1)
        forest.link(*near_pairs(parts, lo[single], lo2[single]))
        lo, hi, lo2, hi2, err = pairs = pairs[:, ~single]
        if not pairs.shape[1]:
            continue
        if depth not in ones:
            if len(ones) > 64:
                ones.clear()
            p, w, bit = levels[depth]
            ones[depth] = np.r_[0, np.cumsum((parts[p].words[w] >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)].astype(np.int32)
        count = ones[depth]
        mid, mid2 = hi - (count[hi] - count[lo]), hi2 - (count[hi2] - count[lo2])
        own = (lo == lo2) & (hi == hi2)
        split = [np.stack(x) for x in ((lo, mid, lo2, mid2, err), (mid, hi, mid2, hi2, err), (lo, mid, mid2, hi2, err + 1))]
        split.append(np.stack((mid, hi, lo2, mid2, err + 1))[:, ~own])
        x = np.concatenate(split, axis=1)
        x = x[:, (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= parts[levels[depth][0]].budget)]
        if depth + 1 < len(levels) and levels[depth + 1][0] != levels[depth][0]:
            x[4] = 0
        if x.shape[1]:
            stack.append((depth + 1, x))
    return forest.label


def block_masks(budget: int, rows: int) -> list[int]:
    """Bit masks of which at least one covers no differing bit of any pair within ``budget``.

    64 bits are cut into budget + extra blocks; some ``extra`` of them must agree. More blocks make
    smaller groups at more copies of a key; the number depends on ``rows`` alone.
    """
    extra = 1
    while extra < 4 and rows >> (64 * extra // (budget + extra)) > 1 << 16:
        extra += 1
    cuts = [64 * i // (budget + extra) for i in range(budget + extra + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, extra)]


def in_cells(keys: DataFrame, group: list[str], member: str, most: int) -> DataFrame:
    """``keys`` with a column cell, such that any two rows of a group meet in one cell of at most about ``most`` rows.

    A group beyond ``most`` rows is cut into chunks by a hash of ``member``, and each pair of chunks is a cell; rows are
    copied for as many cells as there are chunks. Groups that large are found by their counts.
    """
    hot = keys.groupBy(*group).agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("chunks")).where("chunks > 2")
    hot = hot.select(*[F.col(c).alias(f"__{c}") for c in group], "chunks")
    if hot.isEmpty():
        return keys.withColumn("cell", F.lit(0))
    hot = written(hot)
    same = reduce(Column.__and__, [F.col(c) == F.col(f"__{c}") for c in group])
    chunk, chunks = F.pmod(F.xxhash64(member), F.col("chunks")).cast("int"), F.col("chunks")
    cells = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(j, chunk) * chunks + F.greatest(j, chunk))
    return keys.join(sent(hot, hot.count()), same, "left").withColumn("cell", F.explode(F.when(chunks.isNotNull(), cells).otherwise(F.array(F.lit(0))))).select(*keys.columns, "cell")


def by_group(keys: DataFrame, group: list[str], rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """``keys`` dealt and sorted by ``group``, in as many partitions as the work of ``rows`` rows asks for, not the bytes."""
    return keys.repartition(tasks_for(keys.sparkSession, rows, per_task), *group).sortWithinPartitions(*group)


def whole_groups(batches: Iterator[pa.RecordBatch], group: int, rows: int = SLICE) -> Iterator[list[np.ndarray]]:
    """Columns of int64 of about ``rows`` rows that end where the first ``group`` columns change; each row is put together once."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        if size >= rows:
            change = np.zeros(batch.num_rows, bool)
            for c, before in zip(columns[:group], held[-1][:group], strict=True):
                change |= c != before[-1]  # sorted: from the first other row on
            cut = int(np.argmax(change)) if change.any() else batch.num_rows
            if change.any():
                held.append([c[:cut] for c in columns])
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size, columns = [], 0, [c[cut:] for c in columns]
        held.append(columns)
        size += len(columns[0])
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def numbered(columns: list[np.ndarray]) -> np.ndarray:
    """The number of each row's group, for rows sorted by ``columns``."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def trie_edges(distinct: DataFrame, budget: int) -> DataFrame:
    """Edges (a, b) that connect all ``fp`` of ``distinct`` within ``budget`` bits: of each trie a forest, not all pairs."""
    n = distinct.count()
    masks = block_masks(budget, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("prefix")) for i, m in enumerate(signed)])).alias("k"))
    keys = in_cells(keys.select("k.part", "k.prefix", "fp"), ["part", "prefix"], "fp", CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, prefix, cell, fps in whole_groups(batches, 3):
            groups = numbered([part, prefix, cell])
            order = np.lexsort((fps.view(np.uint64), groups))
            groups, fps = groups[order], fps[order]
            label = trie_components(groups, [Part((fps.view(np.uint64),), 64, budget)])
            tied = label != np.arange(len(label))
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[label[tied]]), pa.array(fps[tied])], names=["a", "b"])

    group = ["part", "prefix", "cell"]
    return by_group(keys.select(*[F.col(c).cast("long") for c in group], "fp"), group, n * len(masks)).mapInArrow(run, "a long, b long")


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), by alternating large-star and small-star rounds.

    Each round ends in a table in the shared folder: a plan of two would work out the first one many times over. A hub's edges
    are joined with its one minimum, a join that adaptive execution splits where it is skewed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        out = both.join(low, both["u"] == low["w"])
        if large:
            return out.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        kept = out.select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("w").alias("b")))
        return kept.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.where("a <> b").distinct())
    seen = mark(edges)
    if not seen[0]:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(max_rounds):
        edges = written(star(star(edges, True), False))
        if (now := mark(edges)) == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def components(fps: DataFrame, budget: int = 4, join: Callable[[DataFrame, int], DataFrame] = trie_edges) -> DataFrame:
    """doc_id, fp and component_id of every row of ``fps`` (doc_id, fp)."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = written(nodes)
    roots = star_components(join(nodes.select("fp"), budget))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = nodes.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return fps.join(by_fp, fps["fp"] == by_fp["of"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for every row of ``docs``.

    Texts link when their fingerprints differ in at most ``budget`` bits; component_id is the smallest
    id that links reach. A null text counts as empty; texts without words have fingerprint
    zero and link like any other. Texts of fewer words than a shingle are one shingle. Repeated
    rows and ids each get a row. A null id is never a component_id unless its component has no
    other. An empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle))
    out = components(fps, budget)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")



def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id; all columns stay.

    Rows of equal id are one document, of which one row stays. Rows of a null id can't be named in a
    decision and all stay. Texts move at most once, in the join with the ids to drop, and few of those that stay.
    """
    return drop_repeats(docs, written(near_duplicates(docs, id_col, text_col, shingle, budget)), id_col)


def drop_repeats(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without those whose id isn't their ``groups``' component_id (doc_id, component_id), and one row of each id.

    Only rows that a bitmap of the ids flags are joined with the ids to drop; the others stay where they are.
    """
    drop, twice, flag = (unused(docs, name) for name in ("__drop", "__twice", "__flag"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct()
    told = flagged(docs, docs[id_col], gone, flag)
    doubtful = told.where(F.col(flag)).drop(flag)
    kept = told.where(~F.col(flag)).drop(flag).unionByName(doubtful.join(gone, doubtful[id_col] == gone[drop], "left_anti"))
    repeated = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(twice)).count().where("count > 1").select(twice)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept[id_col] == repeated[twice], "left_anti")
    return once.unionByName(kept.join(repeated, kept[id_col] == repeated[twice], "left_semi").dropDuplicates([id_col]))
