"""The registered queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import chat, decontaminate, html, linededup, minhash, packing, phrases, quality, resample, suffixes, tokenids, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_removed")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does to all documents, from the failure bits alone."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), limit=512)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_ids(_table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"), end_id=2)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    return chat.digests(rows.unionAll(extra))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_substrings(_table(spark, sf_dir, "documents"), length=50, digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, least_words=20, percent=10, seed="2024")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), longest=5, least=100, percent=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_near_duplicates, op4_main_text, op5_decontaminate, op6_quality, op7_packing, op8_token_counts, op9_token_ids, op10_chat, op11_substring_dedup, op12_resampling, op13_phrases, quality_ablation)
}


def _sql_escape(column: str) -> str:
    """chat.escape in SQL: double backslashes, then break each control string after its first character."""
    out = rf"replace({column}, '\', '\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SPACED = r"[^\x20\x09-\x0D]+"

OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, p, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)
), worded AS (
  SELECT doc_id, p, l, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM lines WHERE l <> ''
), windows AS (
  SELECT doc_id, p AS a, lead(p, 2) OVER d AS b, l || chr(10) || lead(l, 1) OVER d || chr(10) || lead(l, 2) OVER d AS w
  FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS nth FROM windows WHERE b IS NOT NULL) WHERE nth > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM later
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE c.p IS NULL), '') END AS text,
       CAST(count(c.p) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id AND c.p = l.p
GROUP BY d.doc_id, d.text
"""

OP3_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACED}') AS w FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingles),
flat AS (SELECT doc_id, hash(x) AS h FROM (SELECT doc_id, unnest(s) AS x FROM shingles)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""

_MEASURED = rf"""
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(t) - length(translate(t, '{quality.UPPER}', '')) AS BIGINT) AS n_upper,
         CASE WHEN len(w) < 3 THEN [] ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END AS g
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
               [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents)
"""

OP6_SQL = rf"""
WITH m AS ({_MEASURED}),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(g) AS x, unnest(range(len(g))) AS i FROM m) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeats AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM starts) GROUP BY doc_id),
f AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN repeats r USING (doc_id)),
v AS (SELECT *, ({" OR ".join(f"({r.fails})" for r in quality.RULES if r.name in quality.POLICIES["base"])}) AS base_failed,
             ({" OR ".join(f"({r.fails})" for r in quality.RULES if r.name in quality.POLICIES["v1"])}) AS failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AS kept FROM v
"""

_V1 = [r for r in quality.RULES if r.name in quality.POLICIES["v1"]]
ABLATION_SQL = rf"""
WITH m AS ({_MEASURED}),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(g) AS x, unnest(range(len(g))) AS i FROM m) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeats AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM starts) GROUP BY doc_id),
f AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN repeats r USING (doc_id)),
failed AS (SELECT doc_id, [x FOR x IN [{", ".join(f"CASE WHEN {r.fails} THEN '{r.name}' END" for r in _V1)}] IF x IS NOT NULL] AS names FROM f)
SELECT rule, CAST(count(*) FILTER (WHERE list_contains(names, rule)) AS BIGINT) AS n_failed,
       CAST(count(*) FILTER (WHERE names = [rule]) AS BIGINT) AS n_only, CAST(count(*) AS BIGINT) AS n_documents
FROM failed, (SELECT unnest([{", ".join(f"'{r.name}'" for r in _V1)}]) AS rule) GROUP BY rule
"""

OP10_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.START + chat.SEP + chat.END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(octet_length(b) - 49)) AS o, b FROM d WHERE octet_length(b) >= 50),
w AS (SELECT doc_id, o, b[o + 1:o + 50] AS s FROM p),
least AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, o FROM w JOIN least USING (s) WHERE doc_id > least),
runs AS (SELECT *, sum(CASE WHEN o - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY o) AS run FROM (
  SELECT *, coalesce(lag(o) OVER (PARTITION BY doc_id ORDER BY o), -1000) AS before FROM hits)),
spans AS (SELECT doc_id, min(o) AS a, max(o) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id UNION ALL SELECT doc_id, 0, 1000000000 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM spans)),
kept AS (SELECT d.doc_id, string_agg(substring(x, 2 * a + 1, 2 * (g.b - a)), '' ORDER BY a) AS x FROM d JOIN gaps g ON g.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(octet_length(b) - length(k.x) // 2 AS BIGINT) AS n_removed,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) n USING (doc_id)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a word byte by byte, over the polynomial's table of 256 steps.
OP12_SQL = rf"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
found AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
flat AS (SELECT doc_id, unnest(w) AS w FROM found),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM flat UNION SELECT w FROM aims)),
coded AS (SELECT w, xor(list_reduce([x_.b for x_ in [{{'b': CAST((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)}} for i in range(length(x) // 2)]],
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM words, steps),
s AS (SELECT bucket, count(*) AS s FROM flat JOIN coded USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aims JOIN coded USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM flat) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS g FROM flat JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (g - ((g % len(w)) + len(w)) % len(w)) // len(w) END AS weight FROM found LEFT JOIN sums USING (doc_id)),
hashed AS (SELECT *, list_reduce([CAST(instr('0123456789abcdef', h[i]) - 1 AS BIGINT) for i in range(1, 9)], lambda a, b: a * 16 + b) AS n FROM (SELECT *, sha256('2024:' || doc_id) AS h FROM weighed)),
scored AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight AS BIGINT) + CAST(floor(-1000 * ln(-ln((n + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM hashed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, p.rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id AND p.rank <= (SELECT count(*) FROM placed) * 10 // 100
"""

OP13_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, phrase, k, CAST(count(*) AS HUGEINT) AS f FROM runs GROUP BY lang, phrase, k HAVING k = 1 OR count(*) >= 100),
n AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, n.n, (1000 * a * n.n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, c.k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:c.k], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') for i in range(1, k - m + 2)] for m in range(2, k)])) AS phrase, a AS longer FROM c WHERE k > 2),
gone AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY lang, phrase)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN gone g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longer IS NULL OR 100 * g.longer < 100 * a)
WHERE rank <= 2000
"""

ORACLES = {"op1_line_dedup": OP1_SQL, "op3_near_duplicates": OP3_SQL, "op6_quality": OP6_SQL, "op10_chat": OP10_SQL, "op11_substring_dedup": OP11_SQL, "op12_resampling": OP12_SQL, "op13_phrases": OP13_SQL, "quality_ablation": ABLATION_SQL}
