"""Training-data operators against brute force, round trips and held-out accuracy, with awkward inputs."""

import hashlib
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heatloom.llm import chat, decontaminate, imatch, jaccard, packing, quality, secrets, sharding, simhash, toxicity, warc
from heatloom.llm.common import table
from heatloom.llm.queries import PROBE, QUERIES, tokenizer_path

LONG = "lorem ipsum dolor " * 4000
AWKWARD = [(1, "Alpha beta gamma delta."), (2, None), (3, ""), (4, "Alpha beta gamma delta."), (4, "Alpha beta gamma delta."), (None, "no id here"), (6, LONG), (7, "é\n\t ü 漢字 😀 <|endoftext|> ²½ İ"), (8, "   ")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, ids that repeat, and columns whose names clash with inner ones."""
    rows = [(i, t, None, "s", None if t is None else len(t), "x", 1, 2) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string, fp long, bucket long").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    return table(spark, sf_dir, "documents").persist()


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- decontamination


def distance(a, b):
    """Fewest edits of ``a`` to any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def squeeze(t):
    return " ".join(re.findall(r"[^\W_]+", t.lower()))


def test_decontamination_finds_what_brute_force_finds():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)]
    pages = []
    for i, t in items:
        for edits in (0, int(0.04 * len(t)), int(0.08 * len(t)), int(0.3 * len(t))):
            s = list(t)
            for _ in range(edits):
                p = rng.randrange(len(s))
                s[p : p + rng.choice((0, 1))] = rng.choice(("", "z", "y"))
            pages.append(" ".join(word() for _ in range(rng.randint(0, 40))) + " " + "".join(s) + " " + " ".join(word() for _ in range(5)))
    matcher = decontaminate.Matcher(items)
    for page, hits in zip(pages, matcher.find(pages), strict=True):
        got = {h[0]: h[3] for h in hits}
        for item in matcher.items:
            d = distance("".join(map(chr, item.codes)), squeeze(page))
            assert (item.item_id in got) == (d <= item.budget), (item.item_id, d, item.budget)
            if item.item_id in got:
                assert got[item.item_id] == d


def test_decontamination_of_items_of_any_length():
    """Items whose budget longer q-grams can't show: every length from 10 to 45 keeps all its edits."""
    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for m in range(10, 46):
        item = word(m)
        matcher = decontaminate.Matcher([(m, item)])
        assert matcher.items[0].budget == int(0.08 * m)
        for edits in range(5):
            for _ in range(8):
                s = list(item)
                for _ in range(edits):
                    p = rng.randrange(len(s))
                    s[p : p + rng.choice((0, 1))] = rng.choice(("", "z", "y"))
                page = word(rng.randint(0, 30)) + "x" + "".join(s) + "x" + word(rng.randint(0, 30))
                hits, d = next(matcher.find([page])), distance(item, page)
                assert bool(hits) == (d <= int(0.08 * m)) and (not hits or min(h[3] for h in hits) == d)


def test_decontamination_counts_in_slices(monkeypatch):
    rng = random.Random(16)
    items = [(0, "ab " * 40), (1, "abab" * 30), (2, "".join(rng.choice("ab") for _ in range(90)))]
    pages = ["ab " * 400, "ab" * 500 + "x" + items[2][1], "".join(rng.choice("ab") for _ in range(3000)), ""] * 2
    once = list(decontaminate.Matcher(items).find(pages))
    assert once[0] and once[1] and not once[3]
    monkeypatch.setattr(decontaminate, "HITS", 500)
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 700)
    assert list(decontaminate.Matcher(items).find(pages)) == once
    for page, hits in zip(pages, once, strict=True):
        for item in decontaminate.Matcher(items).items:
            d = distance("".join(map(chr, item.codes)), squeeze(page))
            assert (d <= item.budget) == any(h[0] == item.item_id for h in hits)


def test_decontamination_of_long_repetitive_texts_takes_bounded_memory():
    import tracemalloc

    matcher = decontaminate.Matcher([(1, "lorem ipsum dolor " * 66)])
    tracemalloc.start()
    hits = next(matcher.find(["lorem ipsum dolor " * 20_000 + "x"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hits) > 290 and peak < 700 << 20


def test_decontamination_of_awkward_tables(spark, awkward, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (None, "lorem ipsum dolor lorem"), (1, "alpha beta gamma"), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.contaminated_regions(awkward, items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got if r["item_id"]) == {(1, 1): 1, (4, 1): 2}
    long = [r for r in got if r["item_id"] is None]
    assert {r["doc_id"] for r in long} == {6} and all(LONG[r["start"] : r["end"]] == "lorem ipsum dolor lorem" for r in long) and len(long) > 1000
    assert decontaminate.contaminated_regions(empty, items).count() == decontaminate.contaminated_regions(awkward, items.limit(0)).count() == 0
    kept = decontaminate.decontaminate(awkward, items)
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == {2: 1, 3: 1, None: 1, 7: 1, 8: 1}


def test_decontamination_spans_case_and_short_items(spark):
    docs = spark.createDataFrame([(1, "x, THE quick-brown  fox jumped over it; y"), (2, "cat"), (3, "concatenate"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jumped over it."), (2, "Cat!"), (3, ""), (4, None), (5, "?!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in decontaminate.contaminated_regions(docs, items).collect()}
    assert got == {(1, 1): (3, 38), (2, 2): (0, 3)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {3, 4}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 4


def test_decontamination_in_blocks(spark, docs, sf_dir, monkeypatch):
    bench = table(spark, sf_dir, "benchmark")
    once = sorted(map(tuple, decontaminate.contaminated_regions(docs, bench).collect()))
    whole = {(d, i) for d, t in texts(docs) for i, b in [(r["item_id"], squeeze(r["text"])) for r in bench.collect()] if b and b in squeeze(t)}
    assert whole and whole <= {(r[0], r[1]) for r in once}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, decontaminate.contaminated_regions(docs, bench).collect())) == once


# --- chat


def test_chat_folds_events(spark):
    log = [
        (1, 1, 10, "delta", "user", "Hel"), (1, 2, 10, "delta", "user", "lo"), (1, 3, 11, "delta", "assistant", "Bad"),
        (1, 4, 11, "regenerate", None, None), (1, 5, 11, "delta", None, "Go"), (1, 6, 11, "delta", None, "od"),
        (1, 7, 10, "edit", None, "Hi"), (1, 8, None, None, None, None), (None, 1, 1, "message", "assistant", "<turn x></turn>\n\\s"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string").repartition(4)
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(events)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "Hi"), ("assistant", "Good"), ("", "")]
    assert back[1]["loss_texts"] == ["Good"]
    assert back[None]["loss_texts"] == ["<turn x></turn>\n\\s"] == [back[None]["turns"][0]["text"]]
    assert chat.format_conversations(events.limit(0)).count() == 0


def brute_fold(log):
    """The final messages of each conversation, event by event."""
    out = {}
    order = sorted(log, key=lambda e: (e[1], e[3] or "delta", e[5] or ""))
    for conv, seq, message, kind, role, text in order:
        own = f"#{seq}" if message is None else str(message)
        m = out.setdefault(conv, {}).setdefault(own, {"pos": seq, "roles": [], "text": ""})
        if role is not None:
            m["roles"].append((seq, role))
        m["text"] = (text or "") if kind in ("edit", "regenerate") else m["text"] + (text or "")
    return {c: [(min(m["roles"])[1] if m["roles"] else "", m["text"]) for _, m in sorted(ms.items(), key=lambda x: (x[1]["pos"], x[0]))] for c, ms in out.items()}


def test_chat_folds_any_log_as_brute_force_does(spark):
    """Random logs of deltas, edits and regenerations with ties, repeated events, nulls and columns of other names."""
    rng = random.Random(31)
    log = []
    for conv in [*range(15), None]:
        for _ in range(rng.randint(1, 60)):
            e = (conv, rng.randint(1, 40), rng.choice([1, 2, 3, 4, None]), rng.choice(["delta", "delta", "delta", "message", "edit", "regenerate", "odd", None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "<b>", "\\", "", None, "é😀 "]) )
            log += [e] * rng.choice([1, 1, 1, 2])
    log += [(99, i, 1, "delta", "assistant", "xy<") for i in range(5000)]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string").repartition(5)
    clash = events.withColumn("pos", F.lit("p")).withColumn("at", F.lit(1)).withColumn("formatted", F.lit(None).cast("string"))
    want = brute_fold(log)
    for df in (events, clash):
        back = chat.read_back(chat.format_conversations(df)).collect()
        assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == want
        assert all(r["loss_texts"] == [t for role, t in want[r["conv_id"]] if role == "assistant"] for r in back)


def test_chat_round_trip_of_any_text(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a>b", None]), "".join(rng.choice("\\<>slg/turn \né😀") for _ in range(rng.randint(0, 60)))) for c in range(20) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for r in chat.read_back(chat.format_conversations(chat.turn_events(turns))).collect():
        own = sorted([x for x in rows if x[0] == r["conv_id"]], key=lambda x: x[1])
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3]) for x in own]
        assert r["loss_texts"] == [x[3] for x in own if x[2] == "assistant"]


def test_chat_query_has_the_probe(spark, sf_dir, docs):
    r = QUERIES["op2_chat"](spark, sf_dir).where("conv_id = -7").first()
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(PROBE.encode()).hexdigest()


# --- fingerprints


def expected_pairs(rows):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode())) - (1 << 64) * (h >> 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    return Counter(out)


def test_imatch_next_documents(spark, docs, awkward, empty):
    for df in (docs, awkward):
        got = imatch.fingerprint_pairs(df).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected_pairs(texts(df))
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert imatch.fingerprint_pairs(empty).count() == 0
    by_text = {}
    for r in imatch.fingerprint_pairs(awkward).collect():
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[1] == by_text[4] and by_text[2] == by_text[3] == {imatch.EMPTY * 120}


def test_imatch_tells_edits_from_others(docs):
    got = imatch.fingerprint_pairs(docs).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.85


def brute_fingerprints(rows):
    """Of every text by the definition: the band's terms, each subset's share of them by their hashes, a hash of those in order."""
    terms = [imatch.terms_of(t) for _, t in rows]
    used = Counter(w for ts in terms for w in ts)
    n = len(rows)
    band = {w for w, c in used.items() if max(imatch.LOW * n, 2) <= c <= max(imatch.HIGH * n, 2)}

    def in_subset(term, k):
        x = ((xxhash.xxh64_intdigest(term) ^ ((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) % 2**64
        return (x >> 11) / 2**53 < imatch.SHARES[k // imatch.SUBSETS]

    def fingerprint(text):
        own = sorted(imatch.terms_of(text) & band) or sorted(imatch.terms_of(text))
        out = []
        for k in range(len(imatch.SHARES) * imatch.SUBSETS):
            picked = b"".join(xxhash.xxh64_intdigest(t).to_bytes(8, "little") for t in own if in_subset(t, k))
            out.append(f"{xxhash.xxh64_intdigest(picked) % (16**6 - 1) + 1:06x}" if picked else "000000")
        return out

    return fingerprint


def brute_likeness(a, b):
    if a == b:
        return 1.0
    for scale in reversed(range(len(imatch.SHARES))):
        pairs = [(x, y) for x, y in zip(a, b, strict=True)][scale * imatch.SUBSETS : (scale + 1) * imatch.SUBSETS]
        filled = [p for p in pairs if p != ("000000", "000000")]
        if len(filled) >= imatch.FILLED or scale == 0:
            return sum(x == y for x, y in filled) / len(filled) if filled else 0.0


def test_imatch_fingerprints_equal_brute_force(spark, docs):
    df = docs.orderBy("doc_id").limit(60)
    rows = texts(df)
    fingerprint = brute_fingerprints(rows)
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in imatch.fingerprint_pairs(df).collect()}
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        own, new, nxt = fingerprint(text), fingerprint(text[: len(text) - k] + after[:k]), fingerprint(after)
        r = got[doc]
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(own), "".join(new))
        assert (r["near_edited"], r["near_next"]) == (brute_likeness(own, new), brute_likeness(own, nxt))


def test_document_frequency(docs):
    want = Counter(w for _, t in texts(docs) for w in imatch.terms_of(t))
    assert {r["term"]: r["n"] for r in imatch.document_frequency(docs).collect()} == want


# --- quality and toxicity


def test_quality_held_out(docs, spark, sf_dir, awkward, empty):
    labels = table(spark, sf_dir, "labels")
    got = quality.score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.85
    assert quality.score_quality(awkward, labels).where("score between 0 and 1").count() == len(AWKWARD)
    assert quality.score_quality(empty, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(awkward, labels.limit(0)).collect()} == {0.5}


def test_surest_rows_equal_brute_force(docs, spark):
    """One round: each view's best rows of each class among all rows, whatever the partitions."""
    features = quality.views(docs).persist()
    table_ = features.toArrow().combine_chunks()
    t, m = quality.matrices(*[table_.column(c).chunk(0) for c in ("t", "g", "m")])
    rng = np.random.default_rng(3)
    models = tuple(quality.fit_logistic(x, rng.integers(0, 2, len(x)), ridge=0.01) for x in (t, m))
    model = quality.CoTrained(*models, None, None)
    ids = table_.column("doc_id").to_pylist()
    taken = (frozenset(ids[:40]), frozenset())
    got = quality.surest(features.repartition(7), model, (5, 9), taken)
    for view, x in enumerate((t, m)):
        p = dict(zip(ids, models[view].score(x), strict=True))
        for label, n in ((0, 5), (1, 9)):
            sure = {i: v if label else 1 - v for i, v in p.items() if i not in taken[view]}
            want = sorted((v for v in sure.values() if v >= quality.SURE), reverse=True)[:n]
            rows = [r for r in got[view].to_pylist() if r["y"] == label]
            assert sorted((r["sure"] for r in rows), reverse=True) == pytest.approx(want)
            assert all(sure[r["doc_id"]] == pytest.approx(r["sure"]) for r in rows)


def test_views_hand_over_both_classes_and_calibrate_on_rows_they_have_not_seen():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.1).astype(float)
    asked = []

    def hand_over(model, quota, taken):
        asked.append(quota)
        return tuple(quality.pa.table({"doc_id": [], "t": [], "g": [], "m": [], "y": []}) for _ in range(2))

    # views of noise, as many features as rows: fitted rows look separated, others don't
    known = quality.Rows(rng.standard_normal((400, 300)), rng.standard_normal((400, 200)), y)
    model = quality.co_train(known, hand_over)
    ones = round(40 * y.mean())
    assert asked == [(40 - ones, ones)] and ones >= 1
    seen = [quality.fit_logistic(model.margins(known.t, known.m)[:, v : v + 1], y, ridge=0.1).weights[0] for v in (0, 1)]
    assert all(abs(float(c.weights[0])) < 0.25 * s for c, s in zip(model.calibrate, seen, strict=True)), (seen, model.calibrate)
    fold = quality.folds_of(y)
    assert all(abs((y[fold == f] == 1).sum() - (y == 1).sum() / quality.FOLDS) <= 1 for f in range(quality.FOLDS))
    assert quality.co_train(quality.Rows(np.zeros((3, 2)), np.zeros((3, 2)), np.ones(3)), hand_over).calibrate is None


def test_quality_learns_from_words(spark):
    """Texts whose surface is alike and that differ in their words alone."""
    rng = random.Random(8)
    good, bad = ([f"{c}{rng.randrange(10**5):05d}" for _ in range(30)] for c in "gh")
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60)), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.score_quality(df.drop("quality"), df.select("doc_id", "quality").where("doc_id < 400")).join(df, "doc_id").where("held_out or doc_id >= 400").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97


def test_toxicity(docs, spark, sf_dir, awkward, empty):
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 3
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for _, r in got.iterrows())
    assert toxicity.score_toxicity(awkward, model).count() == len(AWKWARD)
    assert toxicity.drop_toxic(awkward, labels.limit(0)).count() == len(AWKWARD)
    assert toxicity.drop_toxic(empty, labels).columns == empty.columns
    rows = toxicity.drop_toxic(docs, labels)
    assert rows.columns == docs.columns and rows.count() == toxicity.score_toxicity(docs, model).where("predicted = 0").count()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_trie_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 12))) for _ in range(40)]
    automaton = toxicity.TrieAutomaton(terms)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.choice((0, 1))] = rng.choice(("", "a", "b"))
        w = "".join(w)
        fits = [(d, t) for t in set(terms) if (d := levenshtein(w, t)) <= toxicity.edits_of(len(t))]
        assert automaton.match(w) == (min(fits) if fits else None)


def brute_hit(weights, ordinary, word):
    """(weight, misspelt) by edit distances to every term and from every beginning to every stem."""
    options = []
    for t in weights:
        if t.endswith(toxicity.STEM):
            for k in range(1, len(word)):
                if (d := levenshtein(word[:k], t[:-1])) <= toxicity.edits_of(len(t) - 1):
                    options.append((d, 1, -len(t), t))
        elif (d := levenshtein(word, t)) <= toxicity.edits_of(len(t)):
            options.append((d, 0, 0, t))
    if not options or min(options)[0] and word in ordinary:
        return None
    d, _, _, t = min(options)
    return weights[t] / (1 + d), d > 0


def test_hits_and_features_equal_brute_force():
    rng = random.Random(14)
    word = lambda lo, hi: "".join(rng.choice("abcd") for _ in range(rng.randint(lo, hi)))
    weights = {word(3, 11): rng.uniform(2, 5) for _ in range(12)} | {word(3, 8) + toxicity.STEM: rng.uniform(2, 5) for _ in range(8)}
    ordinary = frozenset(word(4, 8) for _ in range(60))
    scorer = toxicity.Scorer(toxicity.Model(weights, ordinary, toxicity.fit_logistic(np.zeros((0, 4)), np.zeros(0))))
    terms = [t.rstrip(toxicity.STEM) for t in weights]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 12)):
            w = list(rng.choice([word(2, 9), rng.choice(terms), rng.choice(terms) + word(0, 4), rng.choice(sorted(ordinary))]))
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(w) + 1)
                w[p : p + rng.choice((0, 1))] = rng.choice(("", "a", "d"))
            words.append("".join(w))
        words = [w for w in words if w]
        found = [h for w in words if (h := brute_hit(weights, ordinary, w))]
        assert scorer.hits(", ".join(words)) == (len(words), [(*h, 1.0) for h in found])
        exact, wrong = (sum(w for w, m in found if m == kind) for kind in (False, True))
        want = [np.log1p(exact), np.log1p(wrong), max((w for w, _ in found), default=0.0), (exact + wrong) / (len(words) + 20)]
        assert np.allclose(scorer.features(", ".join(words)), want)


def test_lexicon_has_all_terms_that_pass(spark):
    """No number of terms is too many: each of 3,000 equally telling ones stays."""
    rows = [(f"t{i:04d}", 9, 0) for i in range(3000)] + [(f"c{i:04d}", 3, 40) for i in range(500)]
    kept = toxicity.pick_lexicon(spark.createDataFrame(rows, "term string, toxic long, clean long"), 100, 900)
    assert sorted(kept) == sorted(r[0] for r in rows[:3000])


def contexts(text):
    return [h[2] for h in toxicity.Scorer(toxicity.Model({"idiot": 4.0}, frozenset())).hits(text)[1]]


def test_quotation_counts_less():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 4.0}, frozenset()))
    quoted, free = toxicity.QUOTED, 1.0
    assert scorer.hits("you idoit, idiotx")[1] == [(2.0, True, free)]
    assert contexts("they said “you idiot” to me") == contexts('"idiot"') == contexts("„idiot“ «x»") == [quoted]
    assert contexts("you idiot") == contexts('you" idiot') == [free]
    many = "one two three four five six seven eight nine ten "
    assert contexts('he wrote "one two three four five" and you are an idiot he replied "six seven"') == [free]
    assert contexts(f'he wrote "{many * 3}idiot {many * 3}end" again') == [quoted]
    assert contexts(f'a 5" screen, she said "idiot" and left') == [quoted]
    assert contexts('an opening "that never closes idiot\n\nnew "paragraph" idiot') == [free, free]
    assert contexts("‘don’t be an idiot’ he said") == [quoted]
    assert contexts("idiot, “idiot”") == [free, free] and contexts(f"idiot, {many}“idiot”") == [free, quoted]
    assert contexts("") == contexts("“”") == []


def test_toxicity_of_repeated_ids_and_clashing_columns(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    once = toxicity.fit(docs, labels)
    twice = toxicity.fit(docs.unionByName(docs).withColumn("y", F.lit(7)).withColumn("term", F.lit("x")).withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "id"), "id")
    assert once.weights == twice.weights and once.ordinary == twice.ordinary
    rows = docs.withColumn("of", F.lit(1)).withColumn("score", F.lit(None).cast("double"))
    kept = toxicity.drop_toxic(rows.unionByName(rows), labels)
    assert kept.columns == rows.columns and kept.count() == 2 * toxicity.drop_toxic(docs, labels).count()


# --- packing


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    some = [t for _, t in texts(docs)] + [t or "" for _, t in AWKWARD] + ["a_b c__d 's don't '' !'x it's'", "ſŉ ª º ² x½"]
    mine = list(packing.TokenBytes(tokenizer_path())(some))
    assert mine == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_other_tokenizers_encode_whole_texts(docs, tmp_path):
    """Files that keep case, split otherwise or don't mark words' ends."""
    from tokenizers import Tokenizer

    file = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    assert packing.TokenBytes(tokenizer_path()).by_word
    cased = {**file, "normalizer": {"type": "NFC"}}
    whole = {**file, "pre_tokenizer": {**file["pre_tokenizer"], "pretokenizers": file["pre_tokenizer"]["pretokenizers"][1:]}}
    some = ["Some UPPER case, it's 12", "", "é <|endoftext|>"] + [t for _, t in texts(docs)[:20]]
    for i, other in enumerate((cased, whole)):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(other))
        tokens, library = packing.TokenBytes(str(path)), Tokenizer.from_file(str(path))
        assert not tokens.by_word
        assert list(tokens(some)) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def check_packing(df, capacity):
    tokens = packing.TokenBytes(tokenizer_path())
    got = packing.pack(df, tokenizer_path(), capacity).toPandas()
    ids = {}
    for doc, text in texts(df):
        ids.setdefault(doc, []).append(next(tokens([text])) + (1).to_bytes(4, "little"))
    want = Counter((-1 if d is None else d, len(b) // 4) for d, bs in ids.items() for b in bs)
    pieces = got.fillna({"doc_id": -1})
    assert pieces.length.sum() == sum(n * c for (_, n), c in want.items())
    for r in pieces.itertuples():
        options = ids[None if r.doc_id == -1 else int(r.doc_id)]
        assert any(zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(b) // 4 == r.doc_tokens for b in options)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.r_[0, np.cumsum(s.length)[:-1]].tolist() and s.length.sum() <= capacity
    assert sorted(pieces.sequence_id.unique()) == list(range(pieces.sequence_id.nunique()))
    return pieces.length.sum() / (pieces.sequence_id.nunique() * capacity)


def test_packing(docs, awkward, empty):
    assert check_packing(docs, 2048) > 0.9
    check_packing(awkward, 64)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_best_fill_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        fill = packing.best_fill(counts, room)
        assert sum(k * n for k, n in fill) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in fill)


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 1500, "é" * 600
    rows = [(1, "http://a/", big), (5, None, big), (3, "http://b/ c\n", big), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", other), (None, "u", big), (9, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=1000)
    got = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
        want = ("revisit", 5) if html == big and i != 5 else ("response", None)
        assert (got[i]["record_type"], got[i]["refers_to"]) == want
        assert got[i]["payload"] == (None if want[0] == "revisit" else raw)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_seek_table_reads_single_frames(tmp_path):
    import io

    import pyarrow as pa
    import zstandard

    out = pa.OSFile(str(tmp_path / "b.zst"), "wb")
    writer = warc.BundleWriter(out, frame_bytes=100)
    places = [writer.add(bytes([65 + i]) * 40) for i in range(7)]
    writer.close()
    reader = warc.BundleReader(pa.OSFile(str(tmp_path / "b.zst"), "rb"))
    assert [reader.frame(f)[a : a + 40] for f, a in places] == [bytes([65 + i]) * 40 for i in range(7)]
    raw = (tmp_path / "b.zst").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(bytes([65 + i]) * 40 for i in range(7))
    (tmp_path / "b.zst").write_bytes(raw[:3] + b"\xff" + raw[4:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.BundleReader(pa.OSFile(str(tmp_path / "b.zst"), "rb")).frame(0)


# --- secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16)), 1):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_base_secrets_equal_brute_force(spark, docs, awkward):
    rng = random.Random(4)
    parts = ["password", "API_KEY", "apikey", "Token", "secret", "passwd", ": ", "=", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "é😀", "token=secret: ", "ab.cd+ef/gh=="]
    made = [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(awkward.select("doc_id", "text"))
    got = secrets.find_secrets(df)
    want = Counter((d, tuple(brute_spans(t))) for d, t in texts(df))
    assert Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3)) for r in got.collect()) == want


def test_secrets_query_counts_each_kind(spark, tmp_path):
    """Counts are of kinds, not of places among a text's spans; the digest is of the same spans."""
    rng = random.Random(5)
    parts = ["password=", "toKen: ", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "é😀", "\u017fecret=", "x" * 12]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([1, 4, 30])))) for i in range(150)] + [(200, None), (201, ""), (None, "0123456789abcdef " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t in rows:
        spans = brute_spans(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[(d, *(sum(k == kind for _, k, _ in spans) for kind in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = QUERIES["op8_secrets"](spark, str(tmp_path)).drop("spans")
    assert Counter(map(tuple, got.collect())) == want


def test_battery_keeps_random_tokens(spark):
    rng = random.Random(6)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(b64) for _ in range(40)) for _ in range(60)]
    plain = ["internationalization2tokenization0word", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "the-quick-brown-fox-2-jumps-over-the-lazy-dog-again-and-again"]
    df = spark.createDataFrame([(i, f"see {k} now") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.find_secrets(df).where("exists(spans, s -> s.kind = 3)").collect()}
    assert len([i for i in found if i < 60]) >= 50 and not [i for i in found if i >= 60]


def brute_random_spans(text):
    """Kind 3 by the definition, with the three tests and the false-discovery rule in plain Python."""
    tail = lambda z: min(1.0, 2 * math.exp(-z * z / 2) / 2.5066282746310002 * poly(1 / (1 + 0.2316419 * abs(z))))
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

    def p_value(core, alphabet):
        x, n, size = [alphabet.index(c) for c in core], len(core), len(alphabet)
        stat, df = size / n * sum(c * c for c in Counter(x).values()) - n, size - 1
        chi = tail(((max(stat, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
        high = [v >= size // 2 for v in x]
        up, turns = sum(high), sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 2 * up * (n - up) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = tail((turns + 1 - mean) / math.sqrt(var)) if var > 0 else 0.0
        dev = [v - sum(x) / n for v in x]
        square = sum(v * v for v in dev)
        serial = tail((sum(a * b for a, b in zip(dev, dev[1:], strict=False)) / square + 1 / n) * math.sqrt(n)) if square > 0 else 0.0
        return min(1.0, 3 * min(chi, runs, serial))

    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?", text):
        spans = {(m.start(), m.end())}
        if re.search("[+/]", m[0]) and re.search("[_-]", m[0]):
            spans = {(m.start() + r.start(), m.start() + r.end()) for part in secrets.PARTS for r in re.finditer(part + r"{20,}(?:=+(?![A-Za-z0-9+/_=-]))?", m[0])}
        found += sorted(spans)
    tested = []
    for a, b in found:
        core = text[a:b].rstrip("=")
        if re.search("[0-9]", text[a:b]) and re.search("[A-Za-z]", text[a:b]) and len(core) >= 20:
            alphabet = next((letters for pattern, letters in secrets.ENCODINGS if re.search(pattern, core)), None)
            if alphabet:
                tested.append((a, b, len(core), p_value(core, alphabet)))
    m, total = len(tested), sum(t[2] for t in tested)
    scaled = sorted((p * total / (n * m), a, b) for a, b, n, p in tested)
    cut = max((0.05 * (i + 1) / m for i, (q, _, _) in enumerate(scaled) if q <= 0.05 * (i + 1) / m), default=-1.0)
    merged = []
    for a, b in sorted((a, b) for q, a, b in scaled if q > cut):
        if merged and merged[-1][1] > a:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return [(a, 3, b) for a, b in merged if not any(s < b and a < e for s, _, e in brute_spans(text))]


def test_battery_equals_brute_force(spark, docs):
    rng = random.Random(41)
    chars = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab1", "ABCDEFGHabcdefgh01_-", "xy0-/+_"]
    made = []
    for i in range(250):
        parts = []
        for _ in range(rng.randint(0, 8)):
            c = rng.choice(chars)
            parts.append("".join(rng.choice(c) for _ in range(rng.choice((5, 19, 20, 33, 64, 150)))) + rng.choice(["", "", "=", "=="]))
            parts.append(rng.choice([" ", "é ", "=", "/", "_", " password: ", "AKIA"]))
        made.append((20_000 + i, "".join(parts)))
    df = spark.createDataFrame(made, "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id < 60"))
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(df).collect()}
    want = {d: sorted(brute_spans(t) + brute_random_spans(t)) for d, t in texts(df)}
    assert got == want and sum(s[1] == 3 for spans in want.values() for s in spans) > 100


def test_secrets_of_long_texts_and_empty_tables(spark, empty, awkward):
    """Thousands of secrets in one text, and one token as long as a text, in time that follows their number."""
    rng = random.Random(42)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(6000)]
    many = " é ".join(f"password = {h}" for h in hexes)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000))
    df = spark.createDataFrame([(1, many), (2, f"see {blob} now")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(df).collect()}
    left = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert time.time() - began < 60
    assert got[1] == brute_spans(many) and left[1] == " é ".join("[SECRET]" for _ in hexes)
    assert [s for s in got[2] if s[1] == 3] == [(4, 3, 4 + len(blob))] and left[2] == "see [SECRET] now"
    assert secrets.find_secrets(empty).count() == 0 and secrets.find_secrets(awkward).count() == len(AWKWARD)


def test_random_values_behind_names_and_in_paths(spark):
    rng = random.Random(11)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["AWS_SECRET_ACCESS_KEY={}", "https://host/get?sig={}&x=1", "PRIVATE_KEY={}==", "a_b/{}", "config/settings_{}/more-things", "my_files/{}_old"]
    made = [(i, f, "".join(rng.choice(b62 + "+/" if f.startswith(("AWS", "PRI")) else b62) for _ in range(40))) for i, f in enumerate(forms * 20)]
    df = spark.createDataFrame([(i, f"see {f.format(k)} now") for i, f, k in made], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3] for r in secrets.find_secrets(df).collect()}
    left = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    found = Counter()
    for i, f, k in made:
        at = f"see {f.format(k)} now".index(k)
        hit = any(a <= at and at + len(k) <= b for a, b in got[i])
        assert hit == (k not in left[i]) and all(b <= a for (_, b), (a, _) in zip(got[i], got[i][1:], strict=False))
        found[f] += hit
    assert min(found[f] for f in forms) >= 16, found


def test_redaction(spark, awkward, empty):
    text = "a password = abcdefabcdef0123456789 b 0123456789abcdef c"
    df = spark.createDataFrame([(1, text, 56), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_secrets(df).collect()}
    assert got == {1: ("a [SECRET] b [SECRET] c", 23), 2: (None, None), 3: ("clean", 5)}
    assert Counter(map(tuple, secrets.redact_secrets(awkward).collect())) == Counter(map(tuple, awkward.collect()))
    assert secrets.redact_secrets(empty).count() == 0


# --- near duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    least = {}
    for d, f in rows:
        least[f] = min(least.get(f, d), d)
    fps, own = list(least), {f: f for f in least}

    def root(f):
        while own[f] != f:
            f = own[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                own[root(a)] = root(b)
    low = {}
    for f in fps:
        low[root(f)] = min(low.get(root(f), least[f]), least[f])
    return {f: low[root(f)] for f in fps}


def test_near_duplicates_equal_brute_force(docs, spark):
    extra = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(["", " \t\n", "one", "one two three", "ONE two three four five"])] + [(100_010, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    rows = [(d, brute_fingerprint(t)) for d, t in texts(df)]
    want, fp = brute_components(rows), dict(rows)
    for r in simhash.near_duplicates(df).collect():
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == want[fp[r["doc_id"]]]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(want.values())


def test_trie_join_of_planted_chains(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
    rows = list(enumerate(sorted(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long"))
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: want[f] for i, f in rows}


@pytest.mark.parametrize("extra_rows", [0, 1 << 40, 1 << 60])
def test_block_masks_hold_any_pair_within_budget(extra_rows):
    masks, rng = simhash.block_masks(4, extra_rows), random.Random(9)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not x & m for m in masks)


def test_tight_groups_stay_whole():
    base = np.uint64(0x0123456789ABCDEF)
    keys = np.unique(np.array([base ^ np.uint64(i) for i in range(1 << 11)], np.uint64))
    label = simhash.trie_components(np.zeros(len(keys), int), [simhash.Part((keys,), 64, 4)])
    assert (label == 0).all()


def test_near_duplicates_of_awkward_tables(awkward, empty):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect())
    assert got[(4, 1)] == 2 and got[(1, 1)] == 1 and got[(2, 2)] == got[(3, 2)] == got[(8, 2)] == 1 and sum(got.values()) == len(AWKWARD)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "6", "7", "None"]
    twice = awkward.where("doc_id = 4")
    assert simhash.drop_near_duplicates(twice).count() == 1


def five_word_sets(rows):
    out = {}
    for d, t in rows:
        words = t.lower().split()
        out[d] = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def test_pipeline_drops_all_pairs_of_jaccard_four_fifths(spark, docs, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    made = []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 60, 150, 400)))]
        for _ in range(rng.randint(2, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            made.append((200_000 + len(made), " ".join(copy)))
    extra = made + [(300_000 + i, t) for i, t in enumerate(["", " \t\n", "one", "one two three", "ONE two  three"])] + [(300_010, None)]
    df = docs.select("doc_id", "text").where("doc_id < 100").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = five_word_sets(texts(df))
    own = {d: d for d in sets}

    def root(d):
        while own[d] != d:
            d = own[d]
        return d

    ids, pairs = sorted(sets), 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                own[y], pairs = x, pairs + (sets[a] != sets[b])
    assert pairs > 50
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(df).collect()} == {d: root(d) for d in ids}
    assert {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, df, sf_dir).collect()} == {root(d) for d in ids}


def copies_of(rng, groups, most):
    """Texts of groups of copies with some words changed in each."""
    made = []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 60, 150)))]
        for _ in range(rng.randint(2, most)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            made.append((len(made), " ".join(copy)))
    return made


def test_large_groups_give_the_same_in_chunks(spark, monkeypatch):
    """Components that are settled chunk by chunk, and trie groups that are cut into cells, equal whole ones."""
    df = spark.createDataFrame(copies_of(random.Random(21), 5, 60), "doc_id long, text string")
    want = {tuple(r) for r in jaccard.components(df).collect()}
    assert len({c for _, c in want}) > 10
    monkeypatch.setattr(jaccard, "SETS", 9)
    monkeypatch.setattr(jaccard, "CELL", 8)
    assert {tuple(r) for r in jaccard.components(df).collect()} == want


def test_any_two_rows_of_a_group_meet_in_a_cell(spark):
    keys = spark.createDataFrame([(g, i) for g, n in ((1, 3), (2, 60)) for i in range(n)], "g long, m long")
    cells = {}
    for r in simhash.in_cells(keys, ["g"], "m", 10).collect():
        cells.setdefault((r["g"], r["cell"]), set()).add(r["m"])
    assert len(cells) > 50 and max(map(len, cells.values())) < 30
    for g, n in ((1, 3), (2, 60)):
        assert all(any(g == k[0] and {i, j} <= c for k, c in cells.items()) for i in range(n) for j in range(n))


@pytest.mark.parametrize("rows", [100, 10**5, 10**7, 10**10])
def test_windows_let_similar_sets_through(rows):
    """Measured on sets of similarity just over four fifths: some window and the whole fingerprint stay within their budgets."""
    rng = np.random.default_rng(rows)
    bits, budget = jaccard.window_shape(rows, 0.8)
    whole, through = jaccard.whole_budget(0.8), 0
    for _ in range(400):
        both, own = int(rng.integers(8, 200)), None
        own = both // 8
        base = rng.integers(0, 1 << 63, both + 2 * own, np.uint64)
        a, b = (jaccard.wide_fingerprint(np.unique(x)) for x in (base[: both + own], np.r_[base[:both], base[both + own :]]))
        windows = [(int(w) >> (32 * h) & 0xFFFFFFFF) >> (32 - bits) for w in a ^ b for h in (0, 1)]
        through += min(w.bit_count() for w in windows) <= budget and int(np.bitwise_count((a ^ b)[: jaccard.CHECKED]).sum()) <= whole
    assert through >= 0.95 * 400


def test_jaccard_of_awkward_tables(awkward, empty):
    kept = jaccard.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "6", "7", "None"]
    assert jaccard.drop_near_duplicates(empty).count() == 0


# --- sharding


def test_shards(spark, docs, awkward, empty):
    for df, shards in ((docs, 8), (awkward, 3)):
        got = sharding.shard_by_bytes(df, shards).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts(df))
        order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
        assert ids == sorted(ids)
        for s in range(shards):
            own = [r for r in order if r["shard"] == s]
            assert [r["slot"] for r in own] == list(range(len(own)))
            largest = max(r["size"] for r in got)
            assert abs(sum(r["size"] for r in own) - sum(r["size"] for r in got) / shards) <= largest
    assert sharding.shard_by_bytes(empty, 8).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)


# --- pipeline


def test_pipeline_stages(spark, docs, sf_dir, awkward, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    current = docs
    for name, stage in pipeline.STAGES[:-1]:
        nxt = stage(spark, current, sf_dir)
        assert nxt.columns == docs.columns, name
        assert {r["doc_id"] for r in nxt.select("doc_id").collect()} <= {r["doc_id"] for r in current.select("doc_id").collect()}
        current = nxt.persist()
    packed = pipeline.STAGES[-1][1](spark, current, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in current.select("doc_id").collect()}
    assert packed.agg(F.sum("length")).first()[0] == pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0]
    for name, stage in pipeline.STAGES:
        stage(spark, awkward, sf_dir).count()
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_pipeline_equals_brute_force(spark, docs, sf_dir):
    """The documents that reach the packing, with their token counts, by plain Python over whole texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = texts(docs)
    scorer = toxicity.Scorer(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    rows = [r for r, score in zip(rows, scorer.score([t for _, t in rows]), strict=True) if score < 0.5]
    sets, own = five_word_sets(rows), {d: d for d, _ in rows}

    def root(d):
        while own[d] != d:
            d = own[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    rows = [(d, t) for d, t in rows if root(d) == d]
    items = [squeeze(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    matcher = decontaminate.Matcher([(i, x) for i, x in enumerate(items)])
    found = list(matcher.find([t for _, t in rows]))
    assert all(hits or not any(x in squeeze(t) for x in items) for (_, t), hits in zip(rows, found, strict=True))
    rows = [r for r, hits in zip(rows, found, strict=True) if not hits]
    tokens, want = packing.TokenBytes(tokenizer_path()), {}
    for d, t in rows:
        cuts, at, out = sorted((a, e) for a, _, e in brute_spans(t) + brute_random_spans(t)), 0, []
        for a, e in cuts:
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, e)
        want[d] = len(next(tokens(["".join(out) + t[at:]]))) // 4 + 1
    got = {r["doc_id"]: r["doc_tokens"] for r in pipeline.run(spark, sf_dir).select("doc_id", "doc_tokens").distinct().collect()}
    assert got == want
