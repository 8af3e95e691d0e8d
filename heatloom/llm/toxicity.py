"""Toxicity scores from a learned lexicon, matched with its misspellings and weighed by context."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import kept, slices, written
from heatloom.llm.learning import Logistic, fit_logistic, held_out, labelled_sample

#: Labelled documents that a model is fitted on at most.
SAMPLE = 20_000
#: The false-discovery level at which terms are picked, and the least log ratio of use.
LEVEL, MIN_WEIGHT = 0.05, 2.0
#: Words on either side of a quoted hit in which an unquoted one makes it count whole, and what it counts for otherwise.
WINDOW, QUOTED = 8, 0.35
#: Edits that a term of so many characters allows.
EDITS = ((5, 0), (10, 1), (1 << 30, 2))
#: Lengths of the beginnings of words that can be terms too, and what marks them.
STEMS, STEM = range(3, 9), "*"
#: Words that a worker remembers, the first it meets; automaton states, after which it starts anew.
CACHE_WORDS, MAX_STATES = 50_000, 150_000
_WORD = re.compile(r"[^\W\d_]+")
#: Quotation marks, by the mark that opens, those that close.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›"}
_MARKS = re.compile("[" + "".join({*QUOTES, *QUOTES.values()}) + "]|\n[^\\S\n]*\n")


def edits_of(length: int) -> int:
    return next(k for upto, k in EDITS if length < upto)


class State(dict):
    """The states that follow, by character; made when a word first needs them and then kept."""

    __slots__ = ("automaton", "errors", "accept", "stem")

    def __missing__(self, c: str) -> State:
        self[c] = out = self.automaton.after(self, c)
        return out


class TrieAutomaton:
    """The Levenshtein automata of all terms at once: their trie, walked with an error budget.

    Terms under 5 characters allow no edit, under 10 one, others two. A term that ends in ``STEM`` stands for the
    words that begin with it, within the same budget. A state is a set of (trie node, edits so far), the
    fewest edits of each node, as numbers 4 * node + edits, and the best stem that ended so far, so that a character
    costs one lookup.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]  # edits that any term below allows
        for term in sorted(terms):
            letters = term.removesuffix(STEM)
            node, k = 0, edits_of(len(letters))
            self.most[0] = max(self.most[0], k)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            (self.ends if term.endswith(STEM) else self.term)[node] = letters
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, errors: dict[int, int], stem: tuple[int, int, str] | None) -> State:
        """The state of ``errors``, after skipping characters of terms as far as budgets go."""
        todo = list(errors)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = errors[node] + 1
                if e <= self.most[child] and e < errors.get(child, 99):
                    errors[child] = e
                    todo.append(child)
        begun = [(e, -len(t), t) for node, e in errors.items() if (t := self.ends[node]) and e <= edits_of(len(t))]
        stem = min([*begun, *([stem] if stem else [])], default=None)
        key = (tuple(sorted(4 * node + e for node, e in errors.items())), stem)
        if key not in self.states:
            self.states[key] = state = State()
            fits = [(e, t) for node, e in errors.items() if (t := self.term[node]) and e <= edits_of(len(t))]
            state.automaton, state.errors, state.accept, state.stem = self, key[0], min(fits, default=None), stem
        return self.states[key]

    def after(self, state: State, c: str) -> State:
        errors: dict[int, int] = {}
        for code in state.errors:
            node, e = code >> 2, code & 3
            if e + 1 <= self.most[node]:
                errors[node] = min(e + 1, errors.get(node, 99))
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < errors.get(child, 99):
                    errors[child] = cost
        return self._state(errors, state.stem)

    def walk(self, word: str) -> tuple[tuple[int, str] | None, tuple[int, int, str] | None]:
        """(edits, term) of the term nearest to ``word``, and (edits, -length, stem) of the stem nearest to a beginning of it that is not all of it.

        Both within their budgets; of equally near terms the first, of equally near stems the longest.
        """
        if len(self.states) > MAX_STATES:
            self._clear()
        state = before = self.start
        for c in word:
            before, state = state, state[c]
        return state.accept, before.stem

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the term nearest to ``word`` within its budget, the first of equals."""
        return self.walk(word)[0]

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(edits, term or marked stem) that ``word`` stands for: of equal edits, a whole term before a stem."""
        whole, stem = self.walk(word)
        if stem is None or whole is not None and whole[0] <= stem[0]:
            return whole
        return stem[0], stem[2] + STEM


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations open and close in the whole of ``text``.

    A straight mark opens if no letter or digit stands before it and no space after it; an apostrophe within a word
    closes nothing. A quotation that its paragraph doesn't close is none.
    """
    out: list[tuple[int, int]] = []
    opened: dict[str, int] = {}  # by the mark that closes
    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        after = text[at + 1 : at + 2]
        if c[0] == "\n":
            opened.clear()
        elif c in opened and not (c == "’" and after.isalpha()):
            out.append((opened.pop(c), at))
        elif c in QUOTES and not (c == '"' and (not after or after.isspace() or at and text[at - 1].isalnum())):
            opened.setdefault(QUOTES[c], at)
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # of the lexicon's terms: log of how much likelier toxic documents use them
    ordinary: frozenset[str]  # near terms, but clean documents use them too
    logistic: Logistic | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)


class Scorer:
    """Features and scores of whole texts."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, TrieAutomaton(list(model.weights))
        self.known: dict[str, tuple[float, bool] | None] = {}

    def hit(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelt) of a word that stands for a term."""
        found = self.automaton.nearest(word)
        if found is None or found[0] and word in self.model.ordinary:
            return None
        return self.model.weights[found[1]] / (1 + found[0]), found[0] > 0

    def hits(self, text: str) -> tuple[int, list[tuple[float, bool, float]]]:
        """The number of words, and (weight, misspelt, context score) of each hit.

        A hit in a quotation counts for less, unless one outside of any stands within ``WINDOW`` words of it.
        """
        low = text.lower()
        words = _WORD.findall(low)
        known, toxic = self.known, {}
        for w in set(words):
            if w in known:
                found = known[w]
            else:
                found = self.hit(w)
                if len(known) < CACHE_WORDS:
                    known[w] = found
            if found:
                toxic[w] = found
        if not toxic:
            return len(words), []
        quoted = quotations(low)
        at = [(i, m.start()) for i, m in enumerate(_WORD.finditer(low)) if words[i] in toxic]
        said = np.zeros(len(at), bool)
        starts = np.array([p for _, p in at])
        for a, b in quoted:
            said[np.searchsorted(starts, a) : np.searchsorted(starts, b)] = True
        free = np.array([i for (i, _), s in zip(at, said, strict=True) if not s])
        out = []
        for (i, _), inside in zip(at, said.tolist(), strict=True):
            beside = inside and np.searchsorted(free, i - WINDOW) < np.searchsorted(free, i + WINDOW, "right")
            out.append((*toxic[words[i]], QUOTED if inside and not beside else 1.0))
        return len(words), out

    def features(self, text: str) -> list[float]:
        n, hits = self.hits(text)
        exact = sum(w * c for w, wrong, c in hits if not wrong)
        wrong = sum(w * c for w, wrong, c in hits if wrong)
        top = max((w * c for w, _, c in hits), default=0.0)
        return [math.log1p(exact), math.log1p(wrong), top, (exact + wrong) / (n + 20)]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), 4)
        return self.model.logistic.score(x)


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer for ``model``, with the words and states that its tasks before have met."""
    return kept(model.key, lambda: Scorer(model))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each label with the term, a word or the beginning of longer ones; rows are (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0])]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], names=["term", "toxic", "clean"])

        for batch in slices(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
                seen[y].update(words)
                seen[y].update({w[:k] + STEM for w in words for k in STEMS if k < len(w)})
            if sum(map(len, seen)) > 200_000:
                yield out()
        if any(seen):
            yield out()

    return rows.select("y", "text").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of ``k`` or more of ``n`` trials."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total, term = 0.0, 1.0
    first = log(k)
    for i in range(k, n + 1):
        term = math.exp(log(i) - first)
        total += term
        if term < 1e-12:
            break
    return min(1.0, math.exp(first) * total)


def pick_lexicon(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Terms that toxic documents use more, by exact binomial tests under false-discovery control, with weights.

    All terms of two or more toxic documents are tested. A term's p-value follows from its two counts alone, so the
    rule is settled on how many terms have which counts, and only terms that pass reach the driver; the labelled
    sample bounds both.
    """
    share = toxic / (toxic + clean)
    tested = counts.where("toxic >= 2")
    ratio = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    kinds = [(r["toxic"], r["clean"], r["count"]) for r in tested.groupBy("toxic", "clean").count().collect()]
    n = sum(k[2] for k in kinds)
    ranked = sorted((binomial_tail(t, t + c, share), t, c, times) for t, c, times in kinds if t > (t + c) * share)
    seen, last = 0, -1
    for i, (p, _, _, times) in enumerate(ranked):
        seen += times
        if p <= LEVEL * seen / n:
            last = i
    passed = [(t, c) for _, t, c, _ in ranked[: last + 1] if ratio(t, c) > MIN_WEIGHT]
    if not passed:
        return {}
    wanted = counts.sparkSession.createDataFrame(passed, "t long, c long")
    passing = {r["term"]: (r["toxic"], r["clean"]) for r in tested.join(F.broadcast(wanted), (F.col("toxic") == F.col("t")) & (F.col("clean") == F.col("c"))).collect()}  # as many as the sample's counts
    in_word: dict[str, int] = {}
    for t, (used, _) in passing.items():
        if not t.endswith(STEM):
            for k in STEMS:
                in_word[t[:k]] = max(used, in_word.get(t[:k], 0))
    # a beginning counts if it says more than the words that have it
    return {t: ratio(*c) for t, c in passing.items() if not (t.endswith(STEM) and 1.5 * in_word.get(t[:-1], 0) > c[0])}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents that aren't held out; without any, every score is one half.

    ``labels`` has the same ``id_col``. Of rows of one id the one of the greatest text counts; an id with several labels is
    toxic if any of them says so. Null ids and other labels than 0 and 1 are left out; other columns are ignored.
    """
    picked = labelled_sample(labels, label, sample, id_col)
    rows = docs.select(F.col(id_col).alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(rows.join(F.broadcast(picked), F.col("of") == F.col("id")).select("id", "y", "text"))  # as many ids as the sample has
    if rows.count() > rows.select("id").distinct().count():
        rows = written(rows.groupBy("id", "y").agg(F.max("text").alias("text")))
    size = rows.agg(F.sum("y"), F.count("*")).first()
    toxic, clean = size[0] or 0, size[1] - (size[0] or 0)
    weights: dict[str, float] = {}
    ordinary: frozenset[str] = frozenset()
    if toxic and clean:
        counts = written(term_counts(rows))
        weights = pick_lexicon(counts, toxic, clean)
        terms = list(weights)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = TrieAutomaton(terms)
            for batch in batches:
                close = [t for t in batch.column(0).to_pylist() if (m := automaton.nearest(t)) and m[0]]
                yield pa.RecordBatch.from_arrays([pa.array(close, pa.string())], names=["term"])

        used = counts.where(~F.col("term").endswith(STEM)).where(F.col("clean") * toxic * 2 > F.col("toxic") * clean).select("term")
        ordinary = frozenset(r["term"] for r in used.mapInArrow(near, "term string").collect())  # of the sample's words
    model = Model(weights, ordinary)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer_of(model)
        for batch in slices(batches, keep=model.key):
            x = [own.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.select("y", "text").mapInArrow(features, "y int, x array<double>").collect()  # as many as the sample has
    got.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), 4)
    return Model(weights, ordinary, fit_logistic(x, np.array([r["y"] for r in got]), ridge=1.0))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    A null text is empty; a text without words has the score of a text without hits. Rows and ids may
    repeat; a null id is not held out. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in slices(batches, keep=model.key):
            scores = scorer.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose texts score ``threshold`` or more; columns stay as they are, whatever their names.

    Each row is judged by its own text, so repeated rows and ids go or stay by it; a null text is empty and stays
    null, a null id changes nothing. An empty table gives no rows. Where the labels yield no lexicon nothing is known
    of toxicity, and all rows stay.
    """
    model = fit(docs, labels, id_col, text_col)
    if not model.weights:
        return docs
    schema, columns = docs.schema, docs.columns
    where = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in slices(batches, keep=model.key):
            scores = scorer.score([t or "" for t in batch.column(where).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, schema)
