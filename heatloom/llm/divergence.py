"""How far the sources of each language differ in their terms: a systolic tournament of partition-resident groups."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.llm.common import slices, written

#: Probabilities are whole shares of this many; counts are smoothed by SMOOTH.
UNIT, SMOOTH = 1_000_000_000, 2
#: Groups of a language are dealt to at most so many teams, which meet in rounds.
TEAMS = 8
#: Term counts that a task holds before it passes them on, and entries of a slice of the vocabulary.
COUNTED, SLICE = 400_000, 65_536
#: Slices of the vocabulary at least, and entries of a team's vectors in a slice at most (on average).
SLICES, TEAM_SLICE = 2, 1 << 20

#: Everything but letters of ASCII and bytes of other characters separates; A to Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents with the term; counted in the tasks before the shuffle. A group without terms has one row of the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                arrays = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "df"])
            groups.clear()

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, df = groups.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                words = terms_of(text)
                n.update(words)
                df.update(set(words))
            if sum(len(n) for n, _ in groups.values()) > COUNTED:
                yield from out()
        yield from out()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def divergence(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    """floor((p - q)^2 / (p + q)): whole numbers up to 10^9 + 1, whose squares fit 63 bits."""
    return (p - q) * (p - q) // (p + q)


def packed(ids: np.ndarray, p: np.ndarray) -> bytes:
    """Term numbers and shares of a group's slice, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([ids.astype(np.int64), p.astype(np.int64)]).tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def between(a: tuple, b: tuple, size: int) -> int:
    """The divergence of two groups over a slice of ``size`` terms, from (ids, shares, share of absent terms) of each."""
    (ia, pa_, a0), (ib, pb, b0) = a, b
    absent = int(divergence(np.int64(a0), np.int64(b0)))
    _, at, bt = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
    total = int(divergence(pa_, b0).sum()) + int(divergence(pb, a0).sum()) + absent * (size - len(ia) - len(ib) + len(at))
    return total + int((divergence(pa_[at], pb[bt]) - divergence(pa_[at], b0) - divergence(pb[bt], a0)).sum())


def opponent(team: int, turn: int, teams: int) -> int:
    """Whom a team meets in a round of the circle method, from 1 to ``teams`` - 1 (even): the last team stays, the others turn."""
    last = teams - 1
    if team == last:
        return next(t for t in range(last) if (2 * t - turn) % last == 0)
    other = (turn - team) % last
    return last if other == team else other


_VECTOR = "lang string, source string, team int, block int, size int, absent long, vector binary, top array<struct<value:long,item:string>>"
_MET = "lang string, source string, item string, value long"


def vectors(kept: DataFrame, ranks: int) -> DataFrame:
    """A row for each group and slice of the vocabulary: its compressed shares, and the terms that a heap found to stand out most."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lang, source, block = (k.as_py() for k in key)
        first = rows.slice(0, 1).to_pylist()[0]
        rows = rows.filter(rows["id"].is_valid())
        ids = rows["id"].to_numpy()
        order = np.argsort(ids)
        p, q = rows["p"].to_numpy()[order], rows["q"].to_numpy()[order]
        items = np.array(rows["term"].to_pylist(), dtype=object)[order]
        found = np.flatnonzero(p > q)
        best = heapq.nsmallest(ranks, zip((-divergence(p[found], q[found])).tolist(), (t.encode() for t in items[found]), strict=True))
        out = {"lang": lang, "source": source, "team": first["team"], "block": block, "size": first["size"], "absent": first["absent"], "vector": packed(ids[order], p), "top": [{"value": -v, "item": t.decode()} for v, t in best]}
        return pa.Table.from_pylist([out], pa.schema([("lang", pa.string()), ("source", pa.string()), ("team", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), ("absent", pa.int64()), ("vector", pa.binary()), ("top", pa.list_(pa.struct([("value", pa.int64()), ("item", pa.string())])))]))

    return kept.groupBy("lang", "source", "block").applyInArrow(pack, _VECTOR)


def _meet(home: pa.Table, away: pa.Table | None) -> pa.Table:
    """Both directions of every meeting of a home group with a visiting one, or of the home groups among each other."""
    read = lambda t: [(r["lang"], r["source"], (*unpacked(r["vector"]), r["absent"]), r["size"]) for r in t.to_pylist()]
    at_home = read(home)
    pairs = ((a, b) for a in at_home for b in read(away)) if away is not None else ((a, b) for i, a in enumerate(at_home) for b in at_home[:i])
    out: tuple[list, ...] = ([], [], [], [])
    for (lang, one, a, size), (_, other, b, _) in pairs:
        value = between(a, b, size)
        for x, y in ((one, other), (other, one)):
            for column, v in zip(out, (lang, x, y, value), strict=True):
                column.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])


def tournament(residents: DataFrame, teams: int) -> DataFrame:
    """(lang, source, item, value): each pair of groups of a language in both directions, summed over the slices.

    ``residents`` is dealt by (lang, team, block) and stays so. In each round a team's compressed vectors visit the
    partition of the team that they meet; nothing else moves.
    """
    place = ["lang", "team", "block"]
    met = residents.groupBy(*place).applyInArrow(lambda rows: _meet(rows, None), _MET)
    for turn in range(1, teams):
        meets = {t: opponent(t, turn, teams) for t in range(teams)}
        hosts = F.create_map(*[F.lit(v) for t, h in meets.items() if h < t for v in (t, h)])  # the later team visits
        visitors = residents.withColumn("team", hosts[F.col("team")].cast("int")).where("team is not null")
        met = met.unionAll(residents.groupBy(*place).cogroup(visitors.groupBy(*place)).applyInArrow(_meet, _MET))
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = 10, ranks: int = 10, teams: int = TEAMS) -> DataFrame:
    """Ranks, for each source of each language, the other sources by divergence and the terms that stand out most.

    A language keeps the terms of at least ``least`` of its documents. Shares are smoothed and rounded down to whole
    numbers, and all sums are exact. The vocabulary of a language is dealt by hash to slices of some 65,536 terms (fewer where
    many groups share a team), and its groups to teams. A team's vectors of a slice stay in one partition; in teams - 1 rounds the compressed vectors of the
    team it meets come to it, and each meeting gives both directions. A heap of ``ranks`` terms is kept for each group and
    slice, and the best of these heaps are ranked. A source that holds a third of all rows is no larger than its
    vocabulary by then: its counts are summed in the tasks that read it.

    Returns lang, source, part ('pair' or 'term'), item, value, rank. Null text, lang and source count as ''. A language
    without kept terms has pairs of value 0 and no terms; a source alone in its language no pairs. Repeated rows count
    each; ties go to the item whose UTF-8 bytes come first. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    counts = written(term_counts(docs))
    groups = counts.where("term = ''").select("lang", "source")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least)
    kept = written(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("of"))
    langs = written(groups.select("lang").distinct().join(langs, "lang", "left").na.fill(0, ["v", "of"]))
    # slices by the largest vocabulary and by the entries of its groups: a language with fewer has smaller ones
    most = langs.agg(F.max("v")).first()[0] or 0
    entries = counts.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(SLICES, -(-most // SLICE), -(-entries // (teams * TEAM_SLICE)))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    by_block = Window.partitionBy("lang", "block")
    numbered = kept.withColumn("id", F.row_number().over(by_block.orderBy("term")) - 1).withColumn("size", F.count("*").over(by_block).cast("int"))
    numbered = written(numbered)
    sizes = numbered.groupBy("lang", "block").agg(F.max("size").alias("size"))

    own = written(counts.where("term <> ''").drop("df").join(numbered.drop("df"), ["lang", "term"]))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("in_all"))
    # source numbers within a language, for teams: a row for each source
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    members = groups.withColumn("number", number).join(langs, "lang").join(sums, ["lang", "source"], "left").na.fill(0, ["in_all"])
    largest = members.agg(F.max("number")).first()[0]
    teams = max(2, min(teams, (largest or 0) + 1) // 2 * 2)
    share = lambda c, total: F.expr(f"1 + cast(cast({UNIT} as decimal(38,0)) * ({c} + {SMOOTH}) div ({total} + 2 * v) as bigint)")
    members = written(members.withColumn("team", F.pmod("number", F.lit(teams)).cast("int")).withColumn("absent", F.when(F.col("v") > 0, share("0", "in_all")).otherwise(1)))

    none = members.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(sizes, ["lang", "block"], "left").na.fill(0, ["size"])
    columns = ["lang", "source", "team", "block", "size", "absent"]
    none = none.select(*columns, *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("term", "string"), ("p", "long"), ("q", "long"))))
    rows = own.join(members, ["lang", "source"])
    rows = rows.select(*columns, F.col("id").cast("long").alias("id"), "term", share("n", "in_all").alias("p"), share("total", "`of`").alias("q"))
    residents = written(vectors(rows.unionByName(none), ranks)).repartition("lang", "team", "block").persist(StorageLevel.MEMORY_AND_DISK)
    pairs = written(tournament(residents.drop("top"), teams))
    terms = residents.select("lang", "source", F.explode("top").alias("t")).select("lang", "source", F.col("t.item").alias("item"), F.col("t.value").alias("value"))
    terms = written(terms)
    residents.unpersist()

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))
    both = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(ranked(terms).where(F.col("rank") <= ranks).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
