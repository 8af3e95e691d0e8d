"""Repeated strings, source divergence and whitened embeddings against brute force, with awkward inputs."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.llm import common, decontaminate, divergence, jaccard, suffix, whitening
from heatloom.llm.queries import QUERIES

LONG = "lorem ipsum dolor " * 4000
AWKWARD = [(1, "Alpha beta gamma delta."), (2, None), (3, ""), (4, "Alpha beta gamma delta."), (4, "Alpha beta gamma delta."), (None, "no id here"), (6, LONG), (7, "é\n\t ü 漢字 😀 <|endoftext|> ²½ İ"), (8, "   "), (9, "ab" * 900)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, long and periodic texts, repeated rows, ids that repeat, and columns whose names clash with inner ones."""
    rows = [(i, t, None, "s", 1, "x", 1, True) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, uid long, key string, start long, hot boolean").repartition(3).persist()


# --- repeated strings


def cut(texts, length):
    """Bytes, removed bytes, runs and digest of the rest, from counts of all strings."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def cut_by_operator(df, **options):
    taken = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    rows = suffix.cut_repeats(df, **options).select("doc_id", "n_bytes", taken, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_suffix_order_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(80):
        raw = bytes(rng.choice([0, 1, 97, 255][: rng.randint(1, 4)]) for _ in range(rng.randint(1, 300)))
        data = np.frombuffer(raw, np.uint8)
        order = suffix.suffix_order(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        got = suffix.common_prefixes(suffix.words_of(data, 40), order, 40)
        for i in range(1, len(raw)):
            a, b = raw[order[i - 1] :][:40], raw[order[i] :][:40]
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got[i] == same


def test_hashes_of_equal_parts_are_equal():
    data = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint8)
    for size in (1, 5, 8, 13, 128):
        seen = {}
        for i, h in enumerate(suffix.hashes(data, size).tolist()):
            assert seen.setdefault(data[i : i + size].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)


def test_binary_search_finds_strings_of_another_shard():
    rng = random.Random(5)
    make = lambda: [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(6)]
    a, b = make(), make()
    b[2] = a[4]
    one, two = (suffix.Shard([1] * 6, t, [21] * 6, [1] * 6, list(range(6)), 10) for t in (a, b))
    places = np.flatnonzero(two.inside)
    found = one.find(two, places)
    whole, other = b"".join(a), b"".join(b)
    there = {whole[i : i + 10] for i in range(len(whole) - 9)}
    for q, p in zip(places.tolist(), found.tolist(), strict=True):
        assert (p >= 0) == (other[q : q + 10] in there) and (p < 0 or whole[p : p + 10] == other[q : q + 10])


@pytest.mark.parametrize("options", [{}, {"shard": 300}, {"hot": 2}, {"shard": 150, "hot": 6, "gram": 7}])
def test_repeats_match_counts_of_all_strings(spark, options):
    rng = random.Random(7)
    words = ["ab", "cde", "f", "ghij", " ", "é"]
    base = "".join(rng.choice(words) for _ in range(2000))
    texts = []
    for i in range(50):
        at = rng.randrange(len(base))
        texts.append(base[at : at + rng.randint(0, 200)] + "".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + "a" * rng.randint(0, 200) * (i % 7 == 0))
    texts += [texts[3]] * 3 + [base] + [base[300:345] + str(i) * 3 for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted(((i, *w) for i, w in enumerate(cut([t.encode() for t in texts], 40))), key=repr)
    assert cut_by_operator(df, length=40, **options) == want


def test_repeats_of_awkward_and_real_texts(spark, sf_dir, awkward):
    want = sorted(((i, *w) for (i, _), w in zip(AWKWARD, cut([(t or "").encode() for _, t in AWKWARD], 400), strict=True)), key=repr)
    assert cut_by_operator(awkward) == want
    assert suffix.cut_repeats(awkward.limit(0)).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, cut([(r["text"] or "").encode() for r in docs], 400), strict=True)}
    got = QUERIES["op11_suffix"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


# --- source divergence (its SQL is compared in test_sql.py)


def test_every_team_meets_every_other_once():
    for teams in (2, 4, 6, 8, 12):
        met = Counter()
        for turn in range(1, teams):
            for t in range(teams):
                other = divergence.opponent(t, turn, teams)
                assert other != t and divergence.opponent(other, turn, teams) == t
                met[frozenset((t, other))] += 1
        assert len(met) == teams * (teams - 1) // 2 and set(met.values()) == {2}


@pytest.mark.parametrize("teams", [2, 4, 8])
def test_divergence_matches_whole_numbers(spark, teams):
    rng = random.Random(teams)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "Ünder", "x1y", "zz", f"w{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 12))), rng.choice(["en", None, "de"]), rng.choice(["a", "b", "ä", "Z", "", None, "c"])) for i in range(120)]
    rows += [(None, None, "en", "empty"), (1, "", "fr", "only"), (2, "\x00\x40\x7f", "fr", "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "block": F.lit(2)}).repartition(4)
    got = sorted(tuple(r) for r in divergence.source_divergence(df, teams=teams).select("lang", "source", "part", "item", "value", "rank").collect())
    counts, docs, groups = {}, {}, set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.decode() for t in divergence.terms_of(text)]
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    want = []
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        own = {s: {t: counts[lang, s][t] for t in kept} for la, s in groups if la == lang}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in own.items()}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        pairs = [(sum(f(p[source][t], p[s][t]) for t in kept), s) for s in own if s != source]
        terms = [(f(p[source][t], q[t]), t) for t in kept if own[source][t] and p[source][t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            want += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < 10]
    assert got == sorted(want)


def test_divergence_of_awkward_and_no_texts(awkward):
    assert divergence.source_divergence(awkward).collect() == []  # one source alone, no term in ten documents
    assert divergence.source_divergence(awkward.limit(0)).collect() == []


# --- whitened embeddings


def whitened(rows, k=8):
    """vec_id -> deviation, whitened; and explained shares: by whole numbers and one decomposition."""
    fit = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in fit], dtype=object)
    n = len(x)
    away = n * x - x.sum(axis=0)
    c = (away / n).astype(float)
    w, basis = np.linalg.eigh(c.T @ c / n)
    w, basis = w[::-1][:k], basis[:, ::-1][:, :k]
    total = Fraction(int((away**2).sum()), n**3)
    return [i for i, _ in fit], (away**2).sum(axis=1).tolist(), c @ basis / np.sqrt(w), [e / float(total) for e in w]


def check(got, rows):
    ids, deviations, want, shares = whitened(rows)
    k = want.shape[1]
    assert len(got) == len(ids) * k
    table = {(r["vec_id"], r["component"]): r for r in got}
    have = np.array([[table[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-9
    for i, d in zip(ids, deviations, strict=True):
        assert int(table[i, 1]["deviation"]) == d and table[i, 1]["n"] == len(ids)
    for j, s in enumerate(shares):
        assert table[ids[0], j + 1]["explained"] == pytest.approx(s, rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1


def test_whitening_matches_one_decomposition(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, sf_dir).collect(), rows)


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * [900, 3, 1, 0.5, 0.1]).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, v string, deviation int, size int"
    frame = lambda data: spark.createDataFrame([(i, v, "x", 1, 2) for i, v in data], schema).repartition(3)
    check(whitening.whiten(frame(rows + bad)).collect(), rows)
    check(whitening.whiten(frame([*rows, (300, [1.0])])).collect(), rows)  # another length
    assert whitening.whiten(frame(bad)).collect() == [] and whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(None, [0.5, 0.25]), (1, [0.5, 0.25])])).collect() == []  # no variance
    flat = whitening.whiten(frame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in flat) == [(1, 1), (2, 1), (2, 1)]
    with pytest.raises(Exception, match="below 2 to the power"):
        whitening.whiten(frame([(1, [1e9])])).collect()


def test_large_deviations_are_exact(spark):
    rows = spark.createDataFrame([(1, [0.0, 1e6]), (2, [1e6, 0.5])], "vec_id long, c array<double>")
    n = 1 << 20
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.centred(rows, 2, n, np.array([n * 7, 3])).collect()}
    for i, v in ((1, [0.0, 1e6]), (2, [1e6, 0.5])):
        x = [int(np.floor(1024 * c)) + 100000 for c in v]
        assert got[i] == (n * x[0] - n * 7) ** 2 + (n * x[1] - 3) ** 2


# --- near duplicates of the pipeline


def exact_components(rows, least=0.8):
    """id -> smallest id reachable over links of similarity ``least``, by an index of the rarest shingles of each set; and the number of links between different sets."""
    sets = {}
    for i, text in rows:
        sets.setdefault(tuple(jaccard.shingles(text, 5).tolist()), []).append(i)
    count = Counter(h for s in sets for h in s)
    index, up, links = {}, {}, 0

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    keys = sorted(sets, key=len)
    members = [set(s) for s in keys]
    for n, key in enumerate(keys):
        rare = sorted(key, key=lambda h: (count[h], h))[: len(key) - int(np.ceil(least * len(key) - 1e-9)) + 1]
        for m in {m for h in rare for m in index.get(h, ())}:
            both = len(members[n] & members[m])
            if both >= least * (len(key) + len(keys[m]) - both):
                links += 1
                up[root(max(root(n), root(m)))] = min(root(n), root(m))
        for h in rare:
            index.setdefault(h, []).append(n)
    low = {}
    for n, key in enumerate(keys):
        low[root(n)] = min([low.get(root(n), 1 << 62), *sets[key]])
    return {i: low[root(n)] for n, key in enumerate(keys) for i in sets[key]}, links


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_components_equal_an_exact_join(spark, size):
    import os

    if not os.path.isdir(f"/root/testdata/{size}"):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    want, links = exact_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert links > 3
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()} == want


def test_groups_are_settled_by_shingles_too(spark, monkeypatch):
    """A component of few but long texts is cut into chunks, and gives the same."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        words = [f"w{rng.randrange(3000)}" for _ in range(900)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(900)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = exact_components(rows)[0]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(df).collect()} == want
    monkeypatch.setattr(jaccard, "SHINGLES", 4000)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(df).collect()} == want


def test_rows_dealt_a_text_are_bounded():
    """By calculation for uniform fingerprints: copies of a row over all windows and cells, and rows of the groups they meet in."""
    for rows in (10**5, 10**6, 10**7, 10**8, 10**9):
        bits, budget = jaccard.window_shape(rows, 0.8)
        blocks = jaccard.agreeing_blocks(rows, bits, budget)
        group = rows / 2 ** min(sum(hi - lo for lo, hi in b) for b in blocks)
        cells = int(np.ceil(2 * group / jaccard.CELL)) if group > jaccard.CELL else 1
        assert jaccard.WINDOWS * len(blocks) * cells <= 320
        assert group / cells <= jaccard.CELL


@pytest.mark.parametrize("rows", [10**5, 10**8, 10**10])
def test_some_blocks_agree_for_every_pair_within_budget(rows):
    bits, budget = jaccard.window_shape(rows, 0.8)
    blocks = [sum((1 << hi) - (1 << lo) for lo, hi in b) for b in jaccard.agreeing_blocks(rows, bits, budget)]
    rng = random.Random(rows)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(bits), budget))
        assert any(not differ & mask for mask in blocks)


def test_tasks_are_bounded(spark):
    from heatloom.llm.common import MOST_TASKS, tasks_for

    assert tasks_for(spark, 10**15, 1000) == MOST_TASKS and tasks_for(spark, 10, 1000) == 4


# --- decontamination: items of all lengths, and a full block


def test_short_items_may_differ_as_their_rate_allows():
    """At 0.3 an item of nine characters may differ in two, as one of ten may in three."""
    for item, near in (("abcdefghi", "abcdxfghi"), ("abcdefghij", "abcdxfghij"), ("abcd", "abxd")):
        matcher = decontaminate.Matcher([(1, item)], error_rate=0.3)
        for text in (f"so {near} it is", f"so xx{near}xx it is"):
            (hits,) = matcher.find([text])
            assert len(hits) == 1 and hits[0][0] == 1 and hits[0][3] <= 1
    (hits,) = decontaminate.Matcher([(1, "cat")]).find(["category cat"])
    assert hits == [(1, 9, 12, 0)]  # may not differ: whole words only


def test_a_full_block_of_items_fits_a_worker():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(4000)]
    size = 0
    items = []
    while size < decontaminate.BLOCK_CHARS:
        text = " ".join(words[i] for i in rng.integers(0, 4000, 250))
        items.append((len(items), text))
        size += len(text)
    tracemalloc.start()
    matcher = decontaminate.Matcher(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    (hits,) = matcher.find(["well, " + items[7][1] + " indeed"])
    assert [h[0] for h in hits] == [7]


def test_near_duplicates_with_names_used_inside(spark):
    rows = [(1, "a b c d e f g h i j", "x", "y", "z", 4), (2, "a b c d e f g h i j", "x", "y", "z", 4), (2, "a b c d e f g h i j", "x", "y", "z", 4), (3, "other words here", "x", "y", "z", 4), (3, "other words here", "x", "y", "z", 4), (None, None, "x", "y", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __drop string, __twice string, __of string, node int")
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert all(r["__drop"] == "x" and r["node"] == 4 for r in kept.collect())


def test_flags_miss_no_id(spark, monkeypatch):
    """Nulls among them; however many bitmaps there are, and where there would be too many of them all rows are flagged."""
    rows = spark.range(40_000).select((F.col("id") * 7919 - 1000).alias("__map")).unionByName(spark.sql("select cast(null as long) as __map"))
    ids = rows.where("__map % 10 = 0 or __map is null").select(F.col("__map").alias("i"))
    for few in (64, 0):
        monkeypatch.setattr(common, "PARTIAL_BITMAPS", few)
        got = Counter((r["__map"] is None or r["__map"] % 10 == 0, r["flag"]) for r in common.flagged(rows, F.col("__map"), ids, "flag").collect())
        assert got[True, True] == 4001 and not got[True, False] and got[False, True] < 0.08 * 36_000
    monkeypatch.setattr(common, "SENT_BITMAPS", 0)
    assert common.flagged(rows, F.col("__map"), ids, "flag").where("flag").count() == 40_001


def test_near_duplicates_shuffle_few_texts(spark):
    """Without broadcast joins, as with many ids, only texts that may be near copies are shuffled; before, all of them twice."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(24):x}" for _ in range(1500)) for _ in range(900)]
    rows = list(enumerate(texts + [t + " end" for t in texts[:60]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    assert df.count() == 960
    sc, most = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = shuffled()
        kept = jaccard.drop_near_duplicates(df).collect()
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sorted(r["doc_id"] for r in kept) == list(range(900))
    print("moved", moved, "of", sum(len(t) for _, t in rows))
    assert moved < 0.6 * sum(len(t) for _, t in rows)
