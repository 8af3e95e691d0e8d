"""The queries of the training-data operators, by name, with SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.llm import chat, decontaminate, divergence, imatch, packing, quality, secrets, sharding, simhash, suffix, toxicity, warc, whitening
from heatloom.llm.common import table

SHARDS = 8
#: What both turns of conversation -7 say.
PROBE = "\\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(chat.probe(spark, -7, PROBE))
    back = chat.read_back(chat.format_conversations(chat.turn_events(turns)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + length('<turn ></turn>') + 1
    + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  (a second argument of a filter's function is the place)
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.cut_repeats(table(spark, sf_dir, "documents"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return cut.select("doc_id", "n_bytes", taken.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, (SELECT count(*) FROM k WHERE k.lang = l.lang)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM g) l),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, (1 + 1000000000 * (coalesce(n, 0) + 2) // (s.total + 2 * v.v))::HUGEINT AS p
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT lang, term, (1 + 1000000000 * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)))::HUGEINT AS q FROM c GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # null where 64 bits can't hold it


#: XXH64 in SQL: fixed values, and arithmetic on UHUGEINT below two to the power of 64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD = 1 << 64


def _n(v: int) -> str:
    return f"{v % WORD}::UHUGEINT"


def _add(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {WORD}::UHUGEINT)"


def _times(a: str, b: int) -> str:
    return f"(({a} * {_n(b)}) % {WORD}::UHUGEINT)"


def _turned(a: str, r: int) -> str:
    return f"(({a} * {_n(1 << r)}) % {WORD}::UHUGEINT + {a} // {_n(1 << 64 - r)})"


def _mixed(a: str, b: str) -> str:
    return f"xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT))::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_add(acc, _times(lane, P2)), 31), P1)


def xxh64_sql(source: str, text: str, seed: int, name: str = "hashed", raw: bool = False) -> str:
    """CTEs up to ``name`` (``text``, h UBIGINT): the XXH64 of the UTF-8 bytes of each of the CTE ``source``'s texts, or of ``raw`` bytes in hex."""
    lane = lambda at, size: f"('0x' || array_to_string(list_reverse(hex[{at} + 1:{at} + {size}]), ''))::UBIGINT::UHUGEINT"
    folded = lambda start, lanes: f"list_reduce(list_prepend({_n(start)}, {lanes}), lambda a, x: {_round('a', 'x')})"
    striped = [folded(start, f"list_transform(range(n // 32), lambda i: {lane(f'32 * i + {8 * j}', 8)})") for j, start in enumerate((seed + P1 + P2, seed + P2, seed, seed - P1))]
    steps = [_add(_turned("v1", 1), _turned("v2", 7), _turned("v3", 12), _turned("v4", 18))]
    steps += [_add(_times(_mixed("h", _round(_n(0), f"v{j}")), P1), _n(P4)) for j in (1, 2, 3, 4)]
    steps = [f"CASE WHEN n < 32 THEN {_n(seed + P5)} ELSE {e} END" for e in steps]
    steps.append(_add("h", "n::UHUGEINT"))
    eights = f"list_transform(range(n % 32 // 8), lambda i: {_round(_n(0), lane('n // 32 * 32 + 8 * i', 8))})"
    steps.append(f"list_reduce(list_prepend(h, {eights}), lambda a, x: {_add(_times(_turned(_mixed('a', 'x'), 27), P1), _n(P4))})")
    steps.append(f"CASE WHEN n % 8 < 4 THEN h ELSE {_add(_times(_turned(_mixed('h', _times(lane('n // 8 * 8', 4), P1)), 23), P2), _n(P3))} END")
    ones = f"list_transform(range(n % 4), lambda i: {_times(lane('n // 4 * 4 + i', 1), P5)})"
    steps.append(f"list_reduce(list_prepend(h, {ones}), lambda a, x: {_times(_turned(_mixed('a', 'x'), 11), P1)})")
    for shift, factor in ((33, P2), (29, P3), (32, 1)):
        steps.append(_times(_mixed("h", f"h // {_n(1 << shift)}"), factor))
    out = [f"{name}_x AS (SELECT *, len(hex) AS n FROM (SELECT DISTINCT {text}, regexp_extract_all({text if raw else f'hex(encode({text}))'}, '..') AS hex FROM {source}))"]
    out.append(f"{name}_0 AS (SELECT *, {', '.join(f'CASE WHEN n >= 32 THEN {v} END AS v{j + 1}' for j, v in enumerate(striped))}, 0::UHUGEINT AS h FROM {name}_x)")
    out += [f"{name}_{i + 1} AS (SELECT * REPLACE ({e} AS h) FROM {name}_{i})" for i, e in enumerate(steps)]
    return ", ".join([*out, f"{name} AS (SELECT {text}, h::UBIGINT AS h FROM {name}_{len(steps)})"])


OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i + 1:i + 4], ' '))) AS shingle FROM w WHERE len(words) > 0),
{xxh64_sql("s", "shingle", 42)},
f AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))} AS fp FROM s JOIN hashed USING (shingle) GROUP BY 1),
every AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM documents LEFT JOIN f USING (doc_id)),
node AS (SELECT fp, min(doc_id) AS low FROM every GROUP BY 1),
edge AS (SELECT a.fp AS a, b.fp AS b FROM node a, node b WHERE bit_count(xor(a.fp, b.fp)) <= 4),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM every JOIN (SELECT a AS fp, min(low) AS component_id FROM reach JOIN node ON b = node.fp GROUP BY 1) USING (fp)
"""

def _likeness(a: str, b: str) -> str:
    """The share of equal hashes among the filled ones of the fingerprints ``a`` and ``b``, at the finest scale that fills enough."""
    width = imatch.DIGITS * imatch.SUBSETS
    part = lambda x, s: f"regexp_extract_all({x}[{s * width} + 1:{(s + 1) * width}], '.{{{imatch.DIGITS}}}')"
    pairs = lambda s: f"list_zip({part(a, s)}, {part(b, s)})"
    filled = lambda s: f"len(list_filter({pairs(s)}, lambda p: p[1] <> '{imatch.EMPTY}' OR p[2] <> '{imatch.EMPTY}'))"
    equal = lambda s: f"len(list_filter({pairs(s)}, lambda p: p[1] = p[2] AND p[1] <> '{imatch.EMPTY}'))"
    scales = [f"WHEN {filled(s)} >= {imatch.FILLED} THEN {equal(s)}::DOUBLE / {filled(s)}" for s in reversed(range(1, len(imatch.SHARES)))]
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE {' '.join(scales)} WHEN {filled(0)} > 0 THEN {equal(0)}::DOUBLE / {filled(0)} ELSE 0.0::DOUBLE END"


_SUBSETS = len(imatch.SHARES) * imatch.SUBSETS
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(after, length(text) // 3) AS edited FROM o),
v AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
t AS (SELECT doc_id, kind, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM v),
band AS (SELECT term, true AS in_band FROM t WHERE kind = 0 GROUP BY 1
  HAVING count(*) BETWEEN greatest({imatch.LOW} * (SELECT count(*) FROM d), 2) AND greatest({imatch.HIGH} * (SELECT count(*) FROM d), 2)),
m AS (SELECT doc_id, kind, term, in_band, bool_or(coalesce(in_band, false)) OVER (PARTITION BY doc_id, kind) AS any_band FROM t LEFT JOIN band USING (term)),
used AS (SELECT doc_id, kind, term FROM m WHERE in_band OR NOT any_band),
{xxh64_sql("used", "term", 0, "terms")},
mixed AS (SELECT term, h, k.range AS k, {_times(_mixed("h", "(((k.range + 1)::UHUGEINT * " + _n(0x9E3779B97F4A7C15) + f") % {WORD}::UHUGEINT)"), 0xBF58476D1CE4E5B9)} AS x FROM terms, range({_SUBSETS}) k),
again AS (SELECT term, h, k, {_times(_mixed("x", f"x // {_n(1 << 31)}"), 0x94D049BB133111EB)} AS x FROM mixed),
picked AS (SELECT term, k, array_to_string(list_reverse(regexp_extract_all(format('{{:016X}}', h), '..')), '') AS bytes FROM again
  WHERE (x // {_n(1 << 11)})::DOUBLE / {2**53}::DOUBLE < list_extract([{", ".join(f"{x!r}::DOUBLE" for x in imatch.SHARES)}], (k // {imatch.SUBSETS})::INT + 1)),
joined AS (SELECT doc_id, kind, k, string_agg(bytes, '' ORDER BY term) AS raw FROM used JOIN picked USING (term) GROUP BY ALL),
{xxh64_sql("joined", "raw", 0, "marks", raw=True)},
part AS (SELECT v.doc_id, v.kind, k.range AS k, coalesce(format('{{:06x}}', h % {16**imatch.DIGITS - 1} + 1), '{imatch.EMPTY}') AS mark
  FROM v CROSS JOIN range({_SUBSETS}) k LEFT JOIN joined j ON j.doc_id = v.doc_id AND j.kind = v.kind AND j.k = k.range LEFT JOIN marks USING (raw)),
f AS (SELECT doc_id, kind, string_agg(mark, '' ORDER BY k) AS fingerprint FROM part GROUP BY ALL),
r AS (SELECT e.doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, c.fingerprint AS after
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN f c ON c.doc_id = e.next_id AND c.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_likeness("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness("fingerprint", "after")} AS near_next FROM r
"""

#: CRC-32 by half bytes, from a table of sixteen that its polynomial gives.
OP10_SQL = f"""
WITH RECURSIVE poly AS (
  SELECT range AS i, range AS c, 0 AS n FROM range(16)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n + 1 FROM poly WHERE n < 4
), tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE n = 4),
b AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
  lambda c, x: xor(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) >> 4, t[(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) & 15) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, tab),
p AS (SELECT *, 2 * sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS middle, sum(size) OVER () AS total FROM k),
q AS (SELECT *, CAST(middle * {SHARDS} // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat, op3_imatch, op4_quality, op5_packing, op6_warc, op7_toxicity, op8_secrets, op9_simhash, op10_sharding, op11_suffix, op12_divergence, op13_whitening)}

ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op3_imatch": OP3_SQL, "op6_warc": OP6_SQL, "op9_simhash": OP9_SQL, "op10_sharding": OP10_SQL, "op12_divergence": OP12_SQL}
