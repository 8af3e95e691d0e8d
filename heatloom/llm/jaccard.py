"""Near duplicates by the Jaccard similarity of word shingles: tries of wide SimHashes find pairs, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import flagged, sent, slices, written
from heatloom.llm.simhash import CELL, SEED, Part, by_group, drop_repeats, in_cells, numbered, star_components, trie_components, whole_groups

#: Words of 64 bits of a fingerprint, and how many of them are compared as a whole.
WORDS, CHECKED = 8, 4
#: Windows of 32 bits, a trie for each; and how many of all pairs at the least similarity some window must let through.
WINDOWS, REACH = 2 * WORDS, 0.98
#: Standard deviations above the expected number of differing bits up to which a pair's sets are compared.
DEVIATIONS = 3.7
#: Shingles that are mixed at once, and texts and shingles (32 MB) of a group whose sets a task holds at once.
CHUNK, SETS, SHINGLES = 4096, 2048, 1 << 22

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, WORDS, np.uint64)
_TIMES = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_FPS = [f"f{i}" for i in range(WORDS)]


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of ``k`` words; of fewer words, of all as one; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(k, len(words))
    n = len(words) - k + 1
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in ``WORDS`` words of 64 bits, each by a hash of its own."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        x = (hashes[at : at + CHUNK, None] ^ _FLIP) * _TIMES
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def differing(least: float) -> float:
    """The share of bits in which the SimHashes of two sets of similarity ``least`` are expected to differ."""
    return math.acos(min(1.0, 2 * least / (1 + least))) / math.pi


def window_shape(rows: int, least: float) -> tuple[int, int]:
    """(bits, budget) of the windows: as many bits as the number of rows has, and so many differing ones that pairs get through."""
    p, bits = differing(least), min(32, max(12, rows.bit_length()))
    through = 0.0
    for budget in range(bits):
        through += math.comb(bits, budget) * p**budget * (1 - p) ** (bits - budget)
        if 1 - (1 - through) ** WINDOWS >= REACH:
            break
    return bits, budget


def agreeing_blocks(rows: int, bits: int, budget: int) -> list[list[tuple[int, int]]]:
    """Sets of bit ranges of a window, of which some set has no differing bit in any pair within ``budget``: they deal the rows.

    A window is cut into budget + extra blocks, some ``extra`` of which must agree. More of them make smaller groups at more
    copies of a row; groups beyond ``CELL`` cost copies too. The number of least copies is taken, by calculation.
    """

    def copies(extra: int) -> float:
        group = rows / 2 ** (bits * extra // (budget + extra))
        return math.comb(budget + extra, extra) * max(1, math.ceil(2 * group / CELL) if group > CELL else 1)

    extra = min(range(1, 7), key=copies)
    cuts = [bits * i // (budget + extra) for i in range(budget + extra + 1)]
    return [list(c) for c in combinations(list(zip(cuts, cuts[1:], strict=False)), extra)]


def whole_budget(least: float) -> int:
    n, p = 64 * CHECKED, differing(least)
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, node (equal for equal shingle sets), size (of the set) and the fingerprint's words of every row, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, full, fps = [], [], [np.zeros(WORDS, np.uint64)]
            for text in batch.column(1).to_pylist():
                hashes = shingles(text, k)
                nodes.append(_node(hashes))
                full.append(len(hashes))
                fps.append(wide_fingerprint(hashes))
            columns = np.stack(fps)[1:].view(np.int64)
            arrays = [batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(full, pa.int64()), *[pa.array(columns[:, i].copy()) for i in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "size", *_FPS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, size long, " + ", ".join(f"{f} long" for f in _FPS))


def loose_edges(nodes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect all nodes whose fingerprints some window's trie finds within the budgets: of each trie a forest.

    A window's trie lets ``window_shape`` bits differ; the blocks of it that must agree (``agreeing_blocks``) deal the rows; below the window the walk goes on through the checked words, with their own budget.
    """
    n = nodes.count()
    bits, budget = window_shape(n, least)
    blocks = agreeing_blocks(n, bits, budget)
    slots = []
    for t in range(WINDOWS):
        word = F.col(_FPS[t // 2])
        window = F.shiftrightunsigned(F.shiftleft(word, 32) if t % 2 else word, 64 - bits)
        for b, ranges in enumerate(blocks):
            mask = sum((1 << hi) - (1 << lo) for lo, hi in ranges)
            slots.append(F.struct((F.lit((t * len(blocks) + b) << 32).cast("long") + window.bitwiseAND(F.lit(mask).cast("long"))).alias("slot"), window.alias("win")))
    checked = _FPS[:CHECKED]
    keys = nodes.select(F.explode(F.array(*slots)).alias("k"), "node", *checked).select("k.slot", "k.win", "node", *checked)
    keys = in_cells(keys, ["slot"], "node", CELL).select("slot", F.col("cell").cast("long"), "win", "node", *checked)
    whole = whole_budget(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, cell, window, node, *fps in whole_groups(batches, 2):
            groups = numbered([slot, cell])
            keys = [c.view(np.uint64) for c in (window, *fps)]
            order = np.lexsort((*reversed(keys), groups))
            keys, node = [c[order] for c in keys], node[order]
            label = trie_components(groups[order], [Part((keys[0],), bits, budget), Part(tuple(keys[1:]), 64, whole)])
            tied = label != np.arange(len(label))
            if tied.any():
                pairs = np.unique(np.sort(np.stack([node[label[tied]], node[tied]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return by_group(keys, ["slot", "cell"], n * len(slots)).mapInArrow(run, "a long, b long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def settle(labels: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], least: float, whole: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect all rows of unlike labels whose sets are similar, nearest fingerprints first.

    Pairs within the fingerprint budget are compared by their whole sets unless links found before connect them.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    own = np.unique(labels, return_inverse=True)[1]
    up = list(range(own.max() + 1))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(n - 1):
        d = np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(1, dtype=np.int16)
        rest = sizes[i + 1 :]
        j = np.flatnonzero((d <= whole) & (own[i + 1 :] != own[i]) & (np.minimum(rest, sizes[i]) >= least * np.maximum(rest, sizes[i])))
        if len(j):
            found.append((d[j], np.full(len(j), i, np.int32), (j + i + 1).astype(np.int32)))
    if not found:
        return []
    d, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    order, links = np.argsort(d, kind="stable"), []
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        roots = np.array([root(x) for x in range(len(up))])
        part = part[roots[own[left[part]]] != roots[own[right[part]]]]
        for i, j in zip(left[part].tolist(), right[part].tolist(), strict=True):
            x, y = root(own[i]), root(own[j])
            if x != y:
                both = common(sets[i], sets[j])
                if both >= least * (len(sets[i]) + len(sets[j]) - both):
                    up[y] = x
                    links.append((i, j))
    return links


def settled(rows: DataFrame, n: int, least: float) -> DataFrame:
    """Links (a, b) among the rows of each cell (root, cell, node, label, fingerprint, shingles); a node may come twice."""
    whole, columns = whole_budget(least), ["root", "cell", "node", "label", *_FPS[:CHECKED], "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def links() -> list[tuple[int, int]]:
            one = {r[0]: r for r in held}
            each = list(one.values())
            if len(each) < 2:
                return []
            got = settle(np.array([r[1] for r in each]), np.array([r[2] for r in each]), [r[3] for r in each], least, whole)
            return [(each[i][0], each[j][0]) for i, j in got]

        for batch in batches:
            out = []
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1).tolist()
            fps = np.stack([batch.column(4 + i).to_numpy() for i in range(CHECKED)], 1).view(np.uint64)
            sets = batch.column(4 + CHECKED)
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            for i, (group, cell, node, label) in enumerate(keys):
                if last != (group, cell):
                    out += links()
                    held.clear()
                    last = group, cell
                held.append((node, label, fps[i], values[ends[i] : ends[i + 1]].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return by_group(rows.select(*columns), ["root", "cell"], n, SETS).mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """The ``texts`` (node, text, ...) whose node their text has, with shingles in place of text."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            sets = [shingles(t, k) for t in part.column("text").to_pylist()]
            right = np.array([_node(h) for h in sets], np.uint64).view(np.int64) == part.column("node").to_numpy()
            arrays = [*[part.column(c) for c in others], pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "shingles"]).filter(pa.array(right))

    return texts.select(*others, "text").mapInArrow(run, ", ".join(f"{c} long" for c in others) + ", shingles array<long>")


def with_labels(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with label, the node that stands for all that ``links`` connect."""
    found = star_components(links).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(found, F.col("node") == F.col("__node"), "left").withColumn("label", F.coalesce("__root", "node")).drop("__node", "__root")


def links_of(loose: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links that connect all similar nodes of each loose component; ``loose`` is (node, root, size), ``sets`` adds the fingerprint and shingles.

    A component of up to ``SETS`` nodes and ``SHINGLES`` shingles is settled in a task. A larger one is cut into chunks of at most about so many, which are settled each;
    then some nodes of each of the chunks' large groups are brought together, so that the groups join; and
    last all nodes outside the component's largest group meet all nodes, chunk by chunk. Two nodes that no link
    connects before the last step meet in it, so the result is the same as for one chunk.
    """
    n = loose.count()
    weight = F.greatest(F.lit(1 / SETS), F.col("size") / SHINGLES)
    large = loose.groupBy("root").agg(F.ceil(F.sum(weight)).cast("int").alias("chunks")).where("chunks > 1").select(F.col("root").alias("__of"), "chunks")
    some = not large.isEmpty()
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("long")
    if some:
        large = written(large)
        roots = large.count()
        first = sets.join(sent(large, roots), F.col("root") == F.col("__of"), "left").withColumn("cell", F.coalesce(chunk, F.lit(0).cast("long"))).drop("__of", "chunks")
    else:
        first = sets.withColumn("cell", F.lit(0).cast("long"))
    links = written(settled(first.withColumn("label", F.col("node")), n, least))
    if not some:
        return links
    hot = written(sets.join(sent(large, roots), F.col("root") == F.col("__of")).drop("__of"))
    own = written(with_labels(hot.select("node", "root", "chunks", "size").distinct(), links))

    def meet(cells: DataFrame) -> DataFrame:
        """Links among cells (node, label, root, cell)."""
        rows = hot.drop("root", "chunks", "size").join(cells, "node")
        return settled(rows, cells.count(), least)

    rank = F.row_number().over(Window.partitionBy("root", "label").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    heads = own.withColumn("nth", rank).where(F.col("nth") <= 32).join(own.groupBy("label").count().where("count >= 32").select("label"), "label")
    heads = in_cells(heads.select("node", "label", "root"), ["root"], "node", SETS).withColumn("cell", F.col("cell").cast("long"))
    links = written(links.unionByName(meet(written(heads))))
    own = written(with_labels(own.drop("label"), links))
    count = own.groupBy("root", "label").count()
    largest = count.groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("largest")).select(F.col("root").alias("__of"), "largest")
    marked = own.join(sent(largest, roots), F.col("root") == F.col("__of")).drop("__of")  # a row for each large component
    outside = marked.where("label <> largest")
    parts = outside.groupBy("root").agg(F.ceil(F.sum(weight)).cast("long").alias("parts")).select(F.col("root").alias("__of"), "parts")
    marked = written(marked.join(sent(parts, roots), F.col("root") == F.col("__of")).drop("__of"))
    inside = marked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: p * F.col("chunks") + chunk)))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    around = marked.where("label <> largest").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1), lambda c: part * F.col("chunks") + c)))
    cells = inside.unionByName(around).select("node", "label", "root", "cell").distinct()
    return links.unionByName(meet(written(cells)))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest id that links reach, of every row.

    Texts link when the Jaccard similarity of their sets of ``k``-word shingles is ``least`` or more. Equal sets are
    one node. The nodes' wide SimHashes are joined by binary tries, a trie for each window of the fingerprint, within
    a Hamming budget that similar sets keep; inside the components that this gives, whole shingle sets decide. A pair of
    similarity ``least`` passes some window with a chance of ``REACH`` by calculation, more similar ones with a larger one; there is no
    exact way for those who need every such link by proof.

    Null texts count as empty; texts without words are one set. Texts of fewer words than ``k`` are one shingle. Texts are read
    whole; a component of many or long texts is settled in chunks of bounded shingles. Repeated rows and ids have a row each,
    and a null id is never a component_id unless its component has no other. An empty table gives no rows; other columns are ignored.
    """
    rows = written(signatures(docs, id_col, text_col, k))
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("size").alias("size"), *[F.first(f).alias(f) for f in _FPS]))
    found = star_components(written(loose_edges(nodes.where("size > 0"), least)))
    loose = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    loose = written(nodes.select("node", "low", "size", *_FPS[:CHECKED]).join(loose, "node"))
    wanted = loose.select("node", "root", "low", "size", *_FPS[:CHECKED])
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    texts = flagged(texts, F.col("__id"), wanted.select("low"), "__flag").where("__flag").drop("__flag")
    texts = texts.join(wanted, F.col("__id").eqNullSafe(F.col("low"))).drop("__id", "low")
    sets = written(shingle_sets(texts, k))
    joined = with_labels(nodes.select("node", "low"), links_of(loose, sets, least))
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    by_node = joined.join(lowest, "label").select("node", "component_id")
    return rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id; all columns stay.

    Null texts count as empty, and texts without words are one group. Rows of equal id are one document, of
    which one row stays. Rows of a null id can't be named in a decision and all stay. Texts of any length are read whole, ties go to
    the smallest id, other columns may have any names, also those used inside (``__drop``, ``node``), and an empty table gives none.
    """
    return drop_repeats(docs, written(components(docs, id_col, text_col, k, least)), id_col)
