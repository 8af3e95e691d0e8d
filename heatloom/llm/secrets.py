"""Secrets in texts: fixed patterns, and a randomness test battery over inferred encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns and the fewest characters that count, of the value or of the whole match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE, ACCESS, HEX = 12, r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: What the battery looks at: runs of encoding characters, of so many at least; "=" is padding at an end only.
TOKEN, TOKEN_CHARS = r"[A-Za-z0-9+/_-]", 20
PADDING = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Runs into which a token is split that has signs of both base64 alphabets and so fits no encoding.
PARTS = (r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]", r"[A-Za-z0-9]")
#: Level of the false-discovery control.
LEVEL = 0.05
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by the alphabet that their texts keep to, the narrowest first.
ENCODINGS = (
    (r"^[0-9A-F]+$", DIGIT + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGIT + LOWER),
    (r"^[0-9A-Z]+$", DIGIT + UPPER),
    (r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGIT),
    (r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGIT + "+/"),
    (r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGIT + "-_"),
)

_SPAN, _PLAIN, _CLUSTER = "struct<start:int,end:int,found:string>", "struct<start:int,end:int>", "struct<start:int,end:int,fixed:boolean>"
#: Spans that are put together at once.
BLOCK = 128


def fold(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """struct(state, out) after all ``items`` in order; a step gives the next state and an array of what to put out.

    Items are taken in blocks, so that appending copies the blocks before, not every item before.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.struct(done["state"].alias("state"), F.concat(acc["out"], done["out"]).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(zero.alias("state"), none.alias("out"))
    return F.aggregate(F.when(F.size(items) > 0, blocks).otherwise(F.array(items)), start, block)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, found), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["g"]
        end = start + F.length(x["m"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found")))

    spans = _bind(pairs, lambda ps: fold(ps, F.lit(0), step, _SPAN)["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed patterns, by kind."""
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return {"assign": assign, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution, by the rational approximation of Hastings."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / 2.5066282746310002 * poly)


def chi_squared_p(x: Column, n: Column, size: Column) -> Column:
    """Uniformity of symbols ``x`` over ``size``, two-sided (Wilson and Hilferty's cube root)."""
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, v: acc + F.pow(F.size(F.filter(x, lambda y: y == v)), 2.0))
    df = (size - 1).cast("double")
    stat = size / n * squares - n
    return _normal_tail((F.pow(F.greatest(stat, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def runs_p(x: Column, n: Column, size: Column) -> Column:
    """Runs of the upper and the lower half of the alphabet (Wald and Wolfowitz)."""
    high = F.transform(x, lambda v: (v >= F.floor(size / 2)).cast("int"))

    def of(b: Column) -> Column:
        up = F.aggregate(b, F.lit(0), lambda acc, v: acc + v).cast("double")
        turns = F.aggregate(F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, v: acc + v)
        mean = 2 * up * (n - up) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0, _normal_tail((turns + 1 - mean) / F.sqrt(var))).otherwise(F.lit(0.0))

    return _bind(high, of)


def serial_p(x: Column, n: Column) -> Column:
    """Correlation of each symbol with the next."""
    mean = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n

    def of(m: Column) -> Column:
        dev = F.transform(x, lambda v: v - m)
        square = F.aggregate(dev, F.lit(0.0), lambda acc, v: acc + v * v)
        lag = F.aggregate(F.zip_with(F.slice(dev, F.lit(1), F.size(dev) - 1), F.slice(dev, F.lit(2), F.size(dev) - 1), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
        return F.when(square > 0, _normal_tail((lag / square + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))

    return _bind(mean, of)


def battery_p(token: Column, alphabet: Column) -> Column:
    """The battery's p-value of "uniform random over ``alphabet``": the least of three, times three."""
    symbols = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c) - 1)

    def of(x: Column) -> Column:
        n, size = F.size(x).cast("double"), F.length(alphabet)
        return F.least(F.lit(1.0), 3 * F.least(chi_squared_p(x, n, size), runs_p(x, n, size), serial_p(x, n)))

    return _bind(symbols, of)


def _runs(text: Column, chars: str) -> Column:
    """Tokens of ``chars``, with their padding."""
    return matches(text, chars + "{%d,}" % TOKEN_CHARS + PADDING)


def tokens(text: Column) -> Column:
    """Spans of the texts to test: tokens, or the parts of those that fit no encoding as a whole."""

    def parts(t: Column) -> Column:
        moved = [F.transform(_runs(t["found"], p), lambda s: F.struct((t["start"] + s["start"]).alias("start"), (t["start"] + s["end"]).alias("end"), s["found"].alias("found"))) for p in PARTS]
        return F.when(t["found"].rlike("[+/]") & t["found"].rlike("[_-]"), F.array_distinct(F.concat(*moved))).otherwise(F.array(t))

    return F.flatten(F.transform(_runs(text, TOKEN), parts))


def clusters(spans: Column) -> Column:
    """Overlapping ``spans`` (start, end, fixed) as one each, ascending; fixed if any of them is."""
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(False).alias("fixed"))

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        over = last["end"] > s["start"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["fixed"] | s["fixed"]).alias("fixed"))
        return F.when(over, joined).otherwise(s), F.when(over | (last["end"] < 0), F.array().cast(f"array<{_CLUSTER}>")).otherwise(F.array(last))

    def all_of(done: Column) -> Column:
        return F.when(done["state"]["end"] >= 0, F.concat(done["out"], F.array(done["state"]))).otherwise(done["out"])

    return _bind(F.array_sort(spans), lambda ss: _bind(fold(ss, none.cast(_CLUSTER), step, _CLUSTER), all_of))


def _marked(spans: Column, fixed: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(fixed).alias("fixed")))


def random_spans(text: Column, level: float = LEVEL) -> Column:
    """Spans of tokens for which randomness is not rejected.

    A token (20 or more encoding characters, digits and letters among them) is tested against the
    narrowest encoding that holds it; one that no encoding holds, with "+" or "/" and "-" or "_", by its runs of
    each base64 alphabet and of letters and digits. Overlapping findings are one. Within a text, tokens are rejected by the Benjamini-Hochberg rule
    at ``level`` on p-values divided by a weight, the token's share of the mean length: longer tokens,
    on which the tests have more power, are rejected at larger p-values.
    """
    mixed = F.filter(tokens(text), lambda t: t["found"].rlike("[0-9]") & t["found"].rlike("[A-Za-z]"))

    def encoded(t: Column) -> Column:
        core = F.rtrim(t["found"], F.lit("="))
        alphabet = F.lit(None).cast("string")
        for pattern, letters in reversed(ENCODINGS):
            alphabet = F.when(core.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), core.alias("core"), alphabet.alias("alphabet"))

    fit = F.filter(F.transform(mixed, encoded), lambda t: t["alphabet"].isNotNull() & (F.length(t["core"]) >= TOKEN_CHARS))
    tested = F.transform(fit, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.length(t["core"]).alias("n"), battery_p(t["core"], t["alphabet"]).alias("p")))

    def scaled(ts: Column, total: Column) -> Column:
        return F.transform(ts, lambda t: F.struct((t["p"] * total / (t["n"] * F.size(ts))).alias("q"), t["start"].alias("start"), t["end"].alias("end")))

    def kept(ts: Column) -> Column:
        steps = F.transform(F.array_sort(ts), lambda t, i: F.when(t["q"] <= level * (i + 1) / F.size(ts), level * (i + 1) / F.size(ts)).otherwise(F.lit(-1.0)))
        return _bind(F.array_max(steps), lambda cut: F.filter(ts, lambda t: t["q"] > cut))

    def control(ts: Column) -> Column:
        total = F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + t["n"])
        left = _bind(_bind(total, lambda all_of: scaled(ts, all_of)), kept)
        return F.transform(clusters(_marked(left, False)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))

    none = F.array().cast(f"array<{_PLAIN}>")
    return _bind(tested, lambda ts: F.when(F.size(ts) > 0, control(ts)).otherwise(none))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of start, kind number, end; sorted) of every row, from whole texts.

    Kinds 0 to 2 are the fixed patterns; kind 3 are tokens that the test battery takes for random and that
    touch no other span. Starts and ends count code points. A null text is empty and has no
    spans; texts and tokens of any length are read whole, in time that hardly more than follows their length; rows and ids may repeat
    or be null; other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], random_spans(F.col("text")).alias("random"))

    def kind(name: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[kind(k, F.col(k)) for k in KINDS[:3]])
    # found random spans don't overlap one another, so a cluster without a fixed one is a single random span
    apart = F.filter(clusters(F.concat(*[_marked(F.col(k), True) for k in KINDS[:3]], _marked(F.col("random"), False))), lambda c: ~c["fixed"])
    new = F.when(F.size("random") > 0, kind("random", apart)).otherwise(kind("random", F.col("random")))
    return rows.select("doc_id", F.array_sort(F.concat(base, new)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with ``mark`` in place of each of the ascending ``spans``, which don't overlap.

    A block of spans is cut out of the text first, so that finding a place counts characters of its block alone.
    """

    def end_before(ss: Column, i: Column) -> Column:
        return F.when(i > 0, F.try_element_at(ss, i)["end"]).otherwise(F.lit(0))

    def block(ss: Column, i: Column) -> Column:
        begin, own = end_before(ss, i * BLOCK), F.slice(ss, i * BLOCK + 1, F.lit(BLOCK))

        def cut(xs: Column) -> Column:
            part = F.substring(text, begin + 1, F.element_at(xs, -1)["end"] - begin)
            pieces = lambda t: F.transform(xs, lambda s, j: F.concat(F.substring(t, F.greatest(end_before(xs, j), begin) - begin + 1, s["start"] - F.greatest(end_before(xs, j), begin)), F.lit(mark)))
            return F.array_join(_bind(part, pieces), "")

        return _bind(own, cut)

    def whole(ss: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ss) - 1) / BLOCK).cast("int")), lambda i: block(ss, i))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(ss, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _bind(spans, whole)).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret of its texts replaced by a mark; all columns and rows stay.

    Null texts stay null, empty ones empty; texts are read whole, in time near the number of their secrets. Where a text changes,
    ``chars_col`` (if there is one) gets its new length. Each row is judged by its own text, so repeated rows and ids stay alike. Other
    columns may have any names and stay as they are. An empty table gives none.
    """
    name = "spans"
    while name in docs.columns:
        name += "_"
    kinds = {**base_spans(F.col(text_col)), "random": random_spans(F.col(text_col))}
    every = F.concat(*[_marked(c, True) for c in kinds.values()])
    out = docs.withColumn(name, F.when(F.col(text_col).isNotNull(), every))
    out = out.withColumn(name, F.when(F.size(name) > 0, clusters(F.col(name))))
    out = out.withColumn(text_col, redact(F.col(text_col), F.col(name)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.size(name) > 0, F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return out.drop(name)
