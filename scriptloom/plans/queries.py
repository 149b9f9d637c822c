"""The registered queries of the localisation operators, each with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import NON_SPEAKERS, Profile, QaRules
from ..operators import extract, patch, qa, runtime, translate
from ..shared import shared_dir
from ..sources import scripts
from ..sources.store import ProgressStore
from . import adapters as A
from .adapters import with_tables
from .offline import forgetful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = QaRules.parse(
    {
        "window": 4,
        "groups": {"loud": ["error", "purchase"], "calm": ["click", "view"], "empty": []},
        "rules": [
            {"name": "shouts", "category": 2, "pattern": "[A-Z]{5}", "speakers_group": "loud"},
            {"name": "crowded", "category": 3, "pattern": r"\[u", "near": {"group": "loud", "min": 2, "dominant_over": ["calm"]}},
            {"name": "each", "category": 5, "pattern": r": [1-4]\d?\}", "speakers": ["click"], "skip_monologue": True, "dedupe": False},
            {"name": "never", "pattern": ".", "speakers_group": "unknown"},
            {"name": "shouts", "category": 3, "pattern": "[A-Z]{4}", "skip_monologue": True},
        ],
    }
)
KEEP = ["Click", "two words"]
PROFILE = Profile(
    {
        "game_name": "Test", "language_id": "th-ai", "language_name": "Thai", "keep_untranslated": KEEP, "api": {"provider": "echo", "batch_size": 7},
        "speakers": {"user": {"name": "Player", "gender": "?", "role": "asks"}, "assistant": {"name": "Guide"}, "click": {"name": "Click", "role": "clicks"}},
        "auto_set_language": True, "toggle_key": "K_F9",
        "font": {"regular": "th.ttf", "size_scale": 0.9, "replace_fonts": ["a.ttf", "b.ttf", "c.ttf", "d.ttf"], "base_sizes": {"default": 30, "say_dialogue": 33}, "styles": ["default", "button", "notify", "input", "say_label"]},
    }
)
LOUD, CALM = RULES.groups["loud"], RULES.groups["calm"]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def script_query(name: str, sql: str):
    """Register an operator over the script lines."""

    def add(f: Callable[[DataFrame], DataFrame]):
        query(name, sql)(lambda spark, sf_dir: f(A.script(spark, sf_dir)))
        return f

    return add


# ---- extraction ------------------------------------------------------------

_LAID = r"""laid AS (
  SELECT *, length(raw) - length(body) AS indent, body = '' AS blank,
         regexp_matches(body, '^(init\s+(-?\d+\s+)?)?python(\s+\w+)?\s*:\s*$') AS ph, regexp_matches(body, '^\$\s') AS pl, starts_with(body, '#') AS cm
  FROM (SELECT file, line, raw, regexp_replace(raw, '^\s+', '') AS body FROM script)),
py AS (
  SELECT l.file, l.line FROM laid l WHERE EXISTS (
    SELECT 1 FROM (SELECT h.file, h.line, (SELECT min(t.line) FROM laid t WHERE t.file = h.file AND t.line > h.line AND NOT t.blank AND t.indent <= h.indent) AS e FROM laid h WHERE h.ph) b
    WHERE b.file = l.file AND l.line > b.line AND (b.e IS NULL OR l.line < b.e))),
flagged AS (SELECT l.*, p.line IS NOT NULL AS in_python, (p.line IS NOT NULL OR ph OR pl OR cm) AS hidden FROM laid l LEFT JOIN py p ON p.file = l.file AND p.line = l.line)"""
_SCREENS = (
    _LAID
    + r""",
sh AS (SELECT *, NOT hidden AND regexp_matches(body, '^screen\s+\w+.*:\s*$') AS is_header FROM flagged),
sc AS (
  SELECT l.file, l.line FROM sh l WHERE NOT l.hidden AND EXISTS (
    SELECT 1 FROM (SELECT h.file, h.line, (SELECT min(t.line) FROM sh t WHERE t.file = h.file AND t.line > h.line AND NOT t.hidden AND NOT t.blank AND t.indent <= h.indent) AS e FROM sh h WHERE h.is_header) b
    WHERE b.file = l.file AND l.line > b.line AND (b.e IS NULL OR l.line < b.e))),
full_lines AS (SELECT s.*, c.line IS NOT NULL AS in_screen FROM sh s LEFT JOIN sc c ON c.file = s.file AND c.line = s.line)"""
)
_Q = r'"((?:[^"\\]|\\.)*)"'
#: A marked string in double or single quotes.
_MARK = rf"""'_\(\s*(?:{_Q}|''((?:[^''\\]|\\.)*)'')\s*\)'"""
_SAY = rf"^(\s*)([a-zA-Z_]\w*)\s+{_Q}\s*(?:\([^)]*\))?\s*$"
_WORDS = ", ".join(f"'{w}'" for w in NON_SPEAKERS)
_PARSED = rf"""
  SELECT file, line, CASE WHEN regexp_matches(raw, '^(\s*)show\s+text\s+{_Q}') THEN 'text'
    WHEN regexp_matches(raw, '{_SAY}') AND regexp_extract(raw, '{_SAY}', 2) NOT IN ({_WORDS}) THEN 'say'
    WHEN regexp_matches(raw, '^(\s+){_Q}(?:\s+if\s+[^:]+)?:\s*$') THEN 'menu'
    WHEN regexp_matches(raw, '^(\s*){_Q}\s*$') AND indent > 0 THEN 'narrator' END AS kind, raw"""
_TEXTS = rf"""
  SELECT file, line, kind, CASE kind WHEN 'text' THEN '_text' WHEN 'menu' THEN '_menu' WHEN 'narrator' THEN 'narrator' ELSE regexp_extract(raw, '{_SAY}', 2) END AS speaker,
         CASE kind WHEN 'text' THEN regexp_extract(raw, '^(\s*)show\s+text\s+{_Q}', 2) WHEN 'say' THEN regexp_extract(raw, '{_SAY}', 3)
           WHEN 'menu' THEN regexp_extract(raw, '^(\s+){_Q}(?:\s+if\s+[^:]+)?:\s*$', 2) ELSE regexp_extract(raw, '^(\s*){_Q}\s*$', 2) END AS text
  FROM parsed WHERE kind IS NOT NULL"""
_OK = r"regexp_matches(regexp_replace(text, '\[[^\]]+\]|\{[^}]+\}', '', 'g'), '[\p{L}\p{N}]')"
_DEFAULT = _LAID + f""",
parsed AS ({_PARSED} FROM flagged WHERE NOT hidden),
entries AS (SELECT text, speaker, file, line, kind, 0 AS ord FROM ({_TEXTS}) WHERE trim(text) <> '')"""
_FULL = _SCREENS + rf""",
parsed AS ({_PARSED} FROM full_lines WHERE NOT hidden AND NOT is_header AND NOT in_screen),
screen_entries AS (SELECT file, line, regexp_extract(raw, '^\s*(?:text|textbutton|label|tooltip)\s+{_Q}', 1) AS text FROM full_lines
  WHERE NOT hidden AND NOT is_header AND in_screen AND regexp_matches(raw, '^\s*(?:text|textbutton|label|tooltip)\s+{_Q}')),
ui AS (SELECT file, line, unnest([concat(x[1], x[2]) FOR x IN list_zip(regexp_extract_all(raw, {_MARK}, 1), regexp_extract_all(raw, {_MARK}, 2))]) AS text,
  unnest(range(len(regexp_extract_all(raw, {_MARK}, 1)))) AS ord FROM full_lines WHERE NOT cm),
entries AS (
  SELECT text, speaker, file, line, kind, 99 AS ord FROM ({_TEXTS}) WHERE trim(text) <> ''
  UNION ALL SELECT text, '_screen', file, line, 'screen', 99 FROM screen_entries WHERE trim(text) <> '' AND {_OK}
  UNION ALL SELECT text, '_ui', file, line, 'ui', ord FROM ui WHERE trim(text) <> '' AND {_OK})"""


@query("lines_scan", with_tables("doc_lines") + "SELECT file, line, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(raw)) AS BIGINT) AS n_chars FROM doc_lines GROUP BY file, line")
def lines_scan(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).cast("long").alias("n_chars"))


@script_query("line_layout", with_tables("script", more=_LAID) + "SELECT file, line, CAST(indent AS INT) AS indent, blank, ph AS python_header, pl AS python_line, cm AS comment FROM laid")
def line_layout(lines):
    return extract.with_layout(lines).select("file", "line", "indent", "blank", "python_header", "python_line", "comment")


@script_query("block_mask_python", with_tables("script", more=_LAID) + "SELECT file, line FROM py")
def block_mask_python(lines):
    laid = extract.with_layout(lines)
    return extract.inside_blocks(laid, F.col("python_header"))


@script_query("block_mask_screen", with_tables("script", more=_SCREENS) + "SELECT file, line, in_python, in_screen, is_header AS screen_header FROM full_lines")
def block_mask_screen(lines):
    return extract.masked(lines, screens=True).select("file", "line", "in_python", "in_screen", "screen_header")


@script_query("parse_statements", with_tables("script", more=_DEFAULT) + "SELECT text, speaker, file, line, kind FROM entries")
def parse_statements(lines):
    return extract.occurrences(lines).drop("ord")


@script_query("parse_screens", with_tables("script", more=_FULL) + "SELECT text, speaker, file, line, kind FROM entries")
def parse_screens(lines):
    return extract.occurrences(lines, screens=True).drop("ord")


_UNIQUE = "SELECT text, speaker, file, line, kind, seq FROM (SELECT *, row_number() OVER (ORDER BY file, line, ord) - 1 AS seq FROM entries) QUALIFY row_number() OVER (PARTITION BY text ORDER BY seq) = 1"


@script_query("extract_unique", with_tables("script", more=_FULL) + _UNIQUE)
def extract_unique(lines):
    return extract.extract(lines, screens=True)


@script_query("extract_all", with_tables("script", more=_DEFAULT) + "SELECT text, speaker, file, line, kind, row_number() OVER (ORDER BY file, line, ord) - 1 AS seq FROM entries")
def extract_all(lines):
    return extract.extract(lines, dedupe=False)


@query(
    "first_occurrence",
    with_tables("doc_lines") + "SELECT raw AS text, arg_min(file, (doc_id, line)) AS file, min(doc_id) AS doc_id FROM doc_lines WHERE raw <> '' GROUP BY raw",
)
def first_occurrence(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir).filter("raw <> ''").select(F.col("raw").alias("text"), F.struct("doc_id", "line").alias("seq"), "file")
    return extract.first_occurrences(lines).select("text", "file", F.col("seq.doc_id").alias("doc_id"))


@script_query(
    "per_file_summary",
    with_tables("script", more=_DEFAULT) + "SELECT f.file, CAST(count(e.text) AS BIGINT) AS n_strings FROM (SELECT DISTINCT file FROM script) f LEFT JOIN entries e ON e.file = f.file GROUP BY f.file",
)
def per_file_summary(lines):
    return extract.per_file(lines, extract.occurrences(lines))


@script_query("extract_totals", with_tables("script", more=_DEFAULT) + "SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(DISTINCT text) AS BIGINT) AS n_unique FROM entries")
def extract_totals(lines):
    return extract.totals(extract.occurrences(lines))


@query("speaker_list", with_tables("conv") + "SELECT DISTINCT speaker FROM conv")
def speaker_list(spark, sf_dir):
    return extract.speakers(A.conversation_entries(spark, sf_dir))


@script_query("subsystem_literals", with_tables("script") + "SELECT file, line, unnest(regexp_extract_all(raw, '\"([^\"]{4,})\"', 1)) AS text FROM script")
def subsystem_literals(lines):
    return extract.subsystem_literals(lines)


# ---- translation pass ------------------------------------------------------


@query("todo_anti_join", with_tables("ev", "evp") + "SELECT text, speaker, seq FROM ev WHERE NOT EXISTS (SELECT 1 FROM evp WHERE evp.text = ev.text)")
def todo_anti_join(spark, sf_dir):
    return translate.remaining(A.event_entries(spark, sf_dir), A.event_progress(spark, sf_dir)).select("text", "speaker", "seq")


@query(
    "translate_totals",
    with_tables("ev", "evp")
    + "SELECT (SELECT count(*) FROM ev) AS total, (SELECT count(*) FROM evp) AS done, (SELECT count(*) FROM ev WHERE text NOT IN (SELECT text FROM evp)) AS todo",
)
def translate_totals(spark, sf_dir):
    return translate.totals(A.event_entries(spark, sf_dir), A.event_progress(spark, sf_dir))


@query(
    "batches",
    with_tables("ev", "evp")
    + "SELECT seq, place, CAST(place // 20 AS BIGINT) AS batch FROM (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS place FROM ev WHERE text NOT IN (SELECT text FROM evp))",
)
def batches(spark, sf_dir):
    return translate.batches(translate.remaining(A.event_entries(spark, sf_dir), A.event_progress(spark, sf_dir)), 20).select("seq", "place", "batch")


@query(
    "speaker_blurb",
    with_tables("conv")
    + "SELECT seq, CASE speaker WHEN 'user' THEN 'Player (?) — asks' WHEN 'assistant' THEN 'Guide' ELSE 'unknown speaker ''' || speaker || '''' END AS blurb FROM conv",
)
def speaker_blurb(spark, sf_dir):
    return translate.described(A.conversation_entries(spark, sf_dir), translate.speaker_table(spark, PROFILE)).select("seq", "blurb")


_SIGNED = " AND ".join(f"list_sort(regexp_extract_all(e.text, '{p}')) = list_sort(regexp_extract_all(p.tr, '{p}'))" for p in (r"\[[^\]]+\]", r"\{[^}]+\}", r"\\[n\"''\\]"))


@query(
    "token_mismatch",
    with_tables("ev", "evp") + f"SELECT e.seq, coalesce(p.tr <> '' AND {_SIGNED}, false) AS ok FROM ev e LEFT JOIN evp p ON p.text = e.text",
)
def token_mismatch(spark, sf_dir):
    rows = A.event_entries(spark, sf_dir)
    replies = qa.with_translations(rows, A.event_progress(spark, sf_dir)).select(F.col("seq").alias("id"), "tr")
    return translate.checked(rows, replies).select("seq", "ok")


@query("last_replies", "SELECT user_id AS id, arg_max(event_type, event_id) AS tr FROM events GROUP BY user_id")
def last_replies(spark, sf_dir):
    return translate.last_replies(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("tr"), F.col("event_id").alias("pos")))


@query(
    "progress_upsert",
    with_tables("ev", "evp")
    + """, new AS (SELECT text, 'v2 ' || min(speaker) AS tr, min(seq) AS pos FROM ev WHERE seq % 4 = 0 GROUP BY text)
SELECT text, arg_max(tr, v) AS tr, arg_min(pos, v) AS pos FROM (SELECT *, 0 AS v FROM evp UNION ALL SELECT text, tr, pos, 1 FROM new) GROUP BY text""",
)
def progress_upsert(spark, sf_dir):
    new = A.event_entries(spark, sf_dir).filter("seq % 4 = 0").groupBy("text").agg(F.concat(F.lit("v2 "), F.min("speaker")).alias("tr"), F.min("seq").alias("pos"))
    return translate.upserted(A.event_progress(spark, sf_dir), new)


@query(
    "translate_pass",
    with_tables("conv", "convp")
    + """SELECT seq, text, upper(replace(text, 'ß', 'SS')) AS tr, 'ok' AS status, CAST(place // 7 AS BIGINT) AS batch
FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM conv WHERE text NOT IN (SELECT text FROM convp))""",
)
def translate_pass(spark, sf_dir):
    """All conversations that lack a translation, by the offline provider."""
    return translate.translate(A.conversation_entries(spark, sf_dir), A.conversation_progress(spark, sf_dir), PROFILE, pause=0)


@query(
    "batch_prompts",
    with_tables("conv", "convp")
    + """SELECT CAST(b AS BIGINT) AS batch, md5('Into Thai:' || chr(10) || chr(10) || '[' || chr(10) || string_agg('{"id": ' || seq || ', "speaker": "' || blurb || '", "kind": "say", "text": ' || CAST(to_json(text) AS VARCHAR) || '}', ',' || chr(10) ORDER BY seq)
  || chr(10) || ']' || CASE WHEN b % 2 = 1 THEN chr(10) || chr(10) || 'These lines came back with mismatched markup; compare every bracket, brace and backslash with the source this time.' ELSE '' END) AS prompt
FROM (SELECT *, place // 7 AS b, CASE speaker WHEN 'user' THEN 'Player (?) — asks' WHEN 'assistant' THEN 'Guide' ELSE 'unknown speaker ''' || speaker || '''' END AS blurb
  FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM conv WHERE text NOT IN (SELECT text FROM convp))) GROUP BY b""",
)
def batch_prompts(spark, sf_dir):
    """What a provider is asked for each batch; odd ones as if asked again."""
    todo = translate.batches(translate.remaining(A.conversation_entries(spark, sf_dir), A.conversation_progress(spark, sf_dir)), 7)
    rows = translate.described(todo, translate.speaker_table(spark, PROFILE)).select("seq", "text", "kind", "blurb", "batch")

    def ask(group):
        import pandas as pd

        batch = int(group["batch"].iloc[0])
        return pd.DataFrame({"batch": [batch], "prompt": [translate.user_prompt(group.sort_values("seq").to_dict("records"), "Thai", retry=batch % 2 == 1)]})

    return rows.groupBy("batch").applyInPandas(ask, "batch long, prompt string").select("batch", F.md5("prompt").alias("prompt"))


@query(
    "translate_retry",
    with_tables("ev", "evp")
    + """SELECT seq, CASE WHEN seq % 5 = 0 OR seq % 7 = 0 THEN '' ELSE '» ' || text END AS tr, CASE WHEN seq % 5 = 0 OR seq % 7 = 0 THEN 'rejected' ELSE 'ok' END AS status
FROM ev WHERE text NOT IN (SELECT text FROM evp)""",
)
def translate_retry(spark, sf_dir):
    """Mismatched lines are asked for once more, and what is missing or empty then is rejected."""
    done = translate.translate(A.event_entries(spark, sf_dir), A.event_progress(spark, sf_dir), PROFILE, "s", pause=0, call=forgetful)
    return done.select("seq", "tr", "status")


@query("entries_file", with_tables("conv") + "SELECT text, speaker, file, line, kind, seq FROM conv")
def entries_file(spark, sf_dir):
    """All conversation entries through a JSON array: written by executors, read by splits."""
    path = f"{shared_dir(spark)}/strings.json"
    scripts.write_entries(A.conversation_entries(spark, sf_dir), path)
    return scripts.read_entries(spark, path)


@query("progress_file", with_tables("ev", "evp") + "SELECT text, tr, row_number() OVER (ORDER BY pos) - 1 AS pos FROM evp")
def progress_file(spark, sf_dir):
    """All translations through a JSON object."""
    path = f"{shared_dir(spark)}/translations.json"
    scripts.write_progress(A.event_progress(spark, sf_dir), path)
    return scripts.read_progress(spark, path)


@query("progress_store", with_tables("ev", "evp") + "SELECT text, CASE WHEN pos % 4 = 0 THEN 'v2 ' || tr ELSE tr END AS tr, pos FROM evp")
def progress_store(spark, sf_dir):
    """All translations by two writes of the store, the second with newer ones for some texts."""
    store = ProgressStore(spark, shared_dir(spark))
    rows = A.event_progress(spark, sf_dir)
    store.append(rows)
    store.append(rows.filter("pos % 4 = 0").selectExpr("text", "concat('v2 ', tr) AS tr", "pos + 1000000 AS pos"))
    return store.read()


@query("reply_recovery", with_tables("conv") + "SELECT seq, text AS tr FROM conv")
def reply_recovery(spark, sf_dir):
    """Noisy replies around each conversation turn, read back."""
    rows = A.conversation_entries(spark, sf_dir)
    clean = F.to_json(F.array(F.struct(F.col("seq").alias("id"), F.col("text").alias("tr"))))
    noisy = rows.select("seq", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("\x1b[31mmodel [v2]\x1b[0m\n"), clean, F.lit("\ndone"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).otherwise(clean).alias("raw"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            found = [(s, r["tr"]) for s, raw in zip(frame["seq"], frame["raw"], strict=True) for r in translate.reply_array(raw) if isinstance(r, dict) and "tr" in r]
            yield pd.DataFrame(found, columns=["seq", "tr"])

    return noisy.mapInPandas(run, "seq long, tr string")


@query("review_sample", with_tables("ev", "evp") + "SELECT text, tr, pos FROM evp ORDER BY md5(text || '#0'), text LIMIT 25")
def review_sample(spark, sf_dir):
    return translate.sample(A.event_progress(spark, sf_dir), 25)


# ---- quality checks --------------------------------------------------------

_ROWS = """rows AS (SELECT e.text, e.speaker, e.file, e.line, e.seq, p.tr FROM ev e LEFT JOIN evp p ON p.text = e.text),
near AS (SELECT *, last_value(l0) OVER w AS loud, last_value(c0) OVER w AS calm FROM (
  SELECT *, sum(CASE WHEN speaker IN ('error', 'purchase') THEN 1 ELSE 0 END) OVER a AS l0, sum(CASE WHEN speaker IN ('click', 'view') THEN 1 ELSE 0 END) OVER a AS c0
  FROM rows WINDOW a AS (PARTITION BY file ORDER BY line, seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
  WINDOW w AS (PARTITION BY file, line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _lost(p: str) -> str:
    gone = f"[x FOR x IN list_distinct(regexp_extract_all(text, '{p}')) IF NOT list_contains(regexp_extract_all(tr, '{p}'), x)]"
    return f"array_to_string(list_sort({gone}), ',')"


_TAGS, _VARS = _lost(r"\{[^}]+\}"), _lost(r"\[[^\]]+\]")
_ROMAN = "[x FOR x IN regexp_extract_all(tr, '[a-zA-Z]{4,}') IF lower(x) NOT IN ('click', 'two words')]"
_HAS = "tr IS NOT NULL AND trim(tr) <> ''"
_COLUMNS = "speaker, file, line, text, coalesce(tr, '') AS tr, seq"
_TECHNICAL = f"""
  SELECT 1 AS category, 'MISSING' AS label, {_COLUMNS} FROM near WHERE NOT coalesce({_HAS}, false)
  UNION ALL SELECT 1, 'TAG:' || {_TAGS}, {_COLUMNS} FROM near WHERE {_HAS} AND {_TAGS} <> ''
  UNION ALL SELECT 1, 'VAR:' || {_VARS}, {_COLUMNS} FROM near WHERE {_HAS} AND {_VARS} <> ''"""
_ISSUES = f"""{_TECHNICAL}
  UNION ALL SELECT 2, 'shouts', {_COLUMNS} FROM near WHERE {_HAS} AND speaker IN ('error', 'purchase') AND regexp_matches(tr, '[A-Z]{{5}}') QUALIFY row_number() OVER (PARTITION BY text ORDER BY seq) = 1
  UNION ALL SELECT 3, 'crowded', {_COLUMNS} FROM near WHERE {_HAS} AND regexp_matches(tr, '\\[u') AND loud >= 2 AND loud >= calm QUALIFY row_number() OVER (PARTITION BY text ORDER BY seq) = 1
  UNION ALL SELECT 5, 'each', {_COLUMNS} FROM near WHERE {_HAS} AND speaker = 'click' AND NOT (text LIKE '(%' AND text LIKE '%)') AND regexp_matches(tr, ': [1-4]\\d?\\}}')
  UNION ALL SELECT 3, 'shouts', {_COLUMNS} FROM near WHERE {_HAS} AND NOT (text LIKE '(%' AND text LIKE '%)') AND regexp_matches(tr, '[A-Z]{{4}}') QUALIFY row_number() OVER (PARTITION BY text ORDER BY seq) = 1
  UNION ALL SELECT 4, 'roman:' || array_to_string(({_ROMAN})[1:3], ','), {_COLUMNS} FROM near WHERE {_HAS} AND len({_ROMAN}) > 0
  UNION ALL SELECT 4, 'short?', {_COLUMNS} FROM near WHERE {_HAS} AND length(text) > 20 AND length(tr) < length(text) * CAST(0.28 AS DOUBLE)"""


def _found(spark, sf_dir, technical_only: bool = False) -> DataFrame:
    return qa.issues(A.event_entries(spark, sf_dir), A.event_progress(spark, sf_dir), RULES, KEEP, technical_only)


@query("qa_technical", with_tables("ev", "evp", more=_ROWS) + _TECHNICAL)
def qa_technical(spark, sf_dir):
    return _found(spark, sf_dir, technical_only=True).drop("check_ord")


@query("qa_issues", with_tables("ev", "evp", more=_ROWS) + _ISSUES)
def qa_issues(spark, sf_dir):
    return _found(spark, sf_dir).drop("check_ord")


@query("qa_near", with_tables("ev", "evp", more=_ROWS) + "SELECT seq, CAST(calm AS BIGINT) AS near_0, CAST(loud AS BIGINT) AS near_1 FROM near")
def qa_near(spark, sf_dir):
    return qa.window_counts(A.event_entries(spark, sf_dir), RULES.groups, ["calm", "loud"], RULES.window).select("seq", "near_0", "near_1")


@query(
    "qa_by_category",
    with_tables("ev", "evp", more=_ROWS) + f"SELECT c.category, CAST(count(i.label) AS BIGINT) AS n_issues FROM (SELECT unnest([1, 2, 3, 4, 5]) AS category) c LEFT JOIN ({_ISSUES}) i ON i.category = c.category GROUP BY c.category HAVING c.category < 5 OR count(i.label) > 0",
)
def qa_by_category(spark, sf_dir):
    return qa.by_category(_found(spark, sf_dir))


@query(
    "qa_summary",
    with_tables("ev", "evp", more=_ROWS)
    + f"SELECT count(*) FILTER (WHERE category <> 4) AS hard, count(*) FILTER (WHERE category = 4) AS review, count(*) AS total, count(*) FILTER (WHERE category <> 4) > 0 AS fails FROM ({_ISSUES})",
)
def qa_summary(spark, sf_dir):
    return qa.summary(_found(spark, sf_dir))


# ---- patches ---------------------------------------------------------------

_SCREENED = "scr AS (SELECT text, min(seq) AS first FROM ev WHERE kind IN ('screen', 'ui') GROUP BY text)"


@query("route_strings", with_tables("ev", "evp", more=_SCREENED) + "SELECT evp.text, tr, first FROM evp JOIN scr USING (text)")
def route_strings(spark, sf_dir):
    return patch.route_strings(A.event_progress(spark, sf_dir), A.event_entries(spark, sf_dir))


@query("route_dictionary", with_tables("ev", "evp", more=_SCREENED) + "SELECT text, tr, pos FROM evp WHERE text NOT IN (SELECT text FROM scr)")
def route_dictionary(spark, sf_dir):
    return patch.route_dictionary(A.event_progress(spark, sf_dir), A.event_entries(spark, sf_dir))


@query("dict_chunks", with_tables("ev", "evp") + "SELECT text, pos, CAST((row_number() OVER (ORDER BY pos) - 1) // 300 AS BIGINT) AS chunk FROM evp")
def dict_chunks(spark, sf_dir):
    return patch.chunks(A.event_progress(spark, sf_dir), 300).select("text", "pos", "chunk")


def _sql_chain(column: str, pairs: list[tuple[str, str]]) -> str:
    plain = lambda s: " || ".join({"\n": "chr(10)", "\r": "chr(13)", "\t": "chr(9)"}.get(c, "'" + c.replace("'", "''") + "'") for c in s)
    for old, new in pairs:
        column = f"replace({column}, {plain(old)}, {plain(new)})"
    return column


_CONTROL = [("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t")]
_DICT = _sql_chain("s", [("\\", "\\\\"), ("'", "\\'"), ("\\\\n", "\\n"), ("\\\\t", "\\t"), ('\\\\"', '\\"'), *_CONTROL])
_NEW = _sql_chain("s", [("\\", "\\\\"), ('"', '\\"'), ("\\\\n", "\\n"), ("\\\\t", "\\t"), ('\\\\\\"', '\\"'), *_CONTROL])
_DECODED = r"array_to_string([CASE x WHEN '\n' THEN chr(10) WHEN '\t' THEN chr(9) ELSE CASE WHEN length(x) = 2 THEN x[2] ELSE x END END FOR x IN regexp_extract_all(s, '\\.|(?s:.)')], '')"
_OLD = _sql_chain(_DECODED, [("\\", "\\\\"), ('"', '\\"'), *_CONTROL])
#: Texts with escapes, quotes and control characters by document.
_TRICKY = r"CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat('it''s \n ', chr(9), text, ' \"x\" \\ end') WHEN 2 THEN concat(text, chr(13), chr(10), '\t C:\new \\n', chr(13)) ELSE concat('\q\', '\', '\', '\', text) END"


@query(
    "literals",
    f"SELECT doc_id, md5('u''' || {_DICT} || '''') AS dict_literal, md5('\"' || {_NEW} || '\"') AS new_literal, md5('\"' || {_OLD} || '\"') AS old_literal FROM (SELECT doc_id, {_TRICKY} AS s FROM documents WHERE text IS NOT NULL)",
)
def literals(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    b = "\\"
    tricky = (
        F.when(F.col("doc_id") % 4 == 0, F.col("text"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(f"it's {b}n "), F.lit("\t"), "text", F.lit(f' {b}"x{b}" {b}{b} end')))
        .when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit(f"\r\n{b}t C:{b}new {b}{b}n\r")))
        .otherwise(F.concat(F.lit(f"{b}q{b}{b}{b}{b}"), "text"))
    )
    s = F.col("s")
    return docs.select("doc_id", tricky.alias("s")).select("doc_id", F.md5(X.dict_literal(s)).alias("dict_literal"), F.md5(X.new_literal(s)).alias("new_literal"), F.md5(X.old_literal(s)).alias("old_literal"))


@query("identifiers", r"SELECT DISTINCT regexp_replace(url, '[^\p{L}\p{N}_]', '_', 'g') AS ident FROM pages")
def identifiers(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select(X.identifier(F.col("url")).alias("ident")).distinct()


_STRINGS_LINES = f"""SELECT 'tl/th-ai/02_th_ai_strings.rpy' AS path, first * 3 + k AS ord, line FROM (
  SELECT first, unnest([0, 1, 2]) AS k, unnest(['', '    old "' || {_OLD.replace("(s,", "(text,")} || '"', '    new "' || {_NEW.replace("(s,", "(tr,")} || '"']) AS line
  FROM (SELECT evp.text, tr, first FROM evp JOIN scr USING (text)))"""
_DICT_LINES = f"""SELECT format('tl/th-ai/{{:02d}}_th_ai_dict.rpy', 1 + (row_number() OVER (ORDER BY pos) - 1) // 500) AS path, pos AS ord,
  '        u''' || {_DICT.replace("(s,", "(text,")} || ''': u''' || {_DICT.replace("(s,", "(tr,")} || ''',' AS line FROM evp WHERE text NOT IN (SELECT text FROM scr)"""


#: The lines of the filter file for PROFILE, word for word, held on file beside this module: no code under test makes them.
FILTER_LINES = (Path(__file__).parent / "expected_filter.txt").read_text(encoding="utf-8").split("\n")[:-1]
_FILTER = "SELECT 'tl/th-ai/00_th_ai_filter.rpy' AS path, unnest(range({})) AS ord, unnest([{}]) AS line".format(len(FILTER_LINES), ", ".join("'" + x.replace("'", "''") + "'" for x in FILTER_LINES))
_PARTS = "(SELECT greatest(1, CAST(ceil(count(*) / 500.0) AS BIGINT)) AS n FROM evp WHERE text NOT IN (SELECT text FROM scr))"
_HEADS = f"""SELECT format('tl/th-ai/{{:02d}}_th_ai_dict.rpy', i) AS path, unnest([-5, -4, -3, -2, -1, 9223372036854775807]) AS ord,
  unnest(['# Thai translation dictionary — auto-generated' || CASE WHEN n > 1 THEN ' (part ' || i || '/' || n || ')' ELSE '' END, '# DO NOT EDIT BY HAND', '', 'init 0 python:', '    _th_ai_translations.update({{', '    }})']) AS line
  FROM (SELECT n, unnest(range(1, n + 1)) AS i FROM {_PARTS})
UNION ALL SELECT 'tl/th-ai/02_th_ai_strings.rpy', unnest([-4, -3, -2, -1]), unnest(['# Thai screen/UI string translations — auto-generated', '# DO NOT EDIT BY HAND', '', 'translate th-ai strings:'])
  FROM (SELECT 1 FROM evp JOIN scr USING (text) LIMIT 1)"""
_PATCH = f"{_DICT_LINES} UNION ALL {_STRINGS_LINES} UNION ALL {_FILTER} UNION ALL {_HEADS}"


def _patch(spark, sf_dir) -> DataFrame:
    return patch.build(A.event_progress(spark, sf_dir), PROFILE, A.event_entries(spark, sf_dir), 500)


@query("patch_lines", with_tables("ev", "evp", more=_SCREENED) + _PATCH)
def patch_lines(spark, sf_dir):
    """All lines of all generated files."""
    return _patch(spark, sf_dir)


@query("patch_files", with_tables("ev", "evp", more=_SCREENED) + f"SELECT path, CAST(count(*) AS BIGINT) AS n_lines FROM ({_PATCH}) GROUP BY path")
def patch_files(spark, sf_dir):
    return _patch(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "patch_written",
    with_tables("ev", "evp", more=_SCREENED)
    + f"SELECT file, line, raw FROM (SELECT regexp_extract(path, '[^/]*$') AS file, CAST(row_number() OVER (PARTITION BY path ORDER BY ord) AS INT) AS line, line AS raw FROM ({_PATCH})) WHERE raw <> ''",
)
def patch_written(spark, sf_dir):
    """The lines of the files as they were written, read back."""
    folder = shared_dir(spark)
    scripts.write_rendered(_patch(spark, sf_dir), folder)
    return scripts.read_lines(spark, f"{folder}/tl/th-ai").filter("raw <> ''")


# ---- runtime ---------------------------------------------------------------


@query("runtime_lookup", with_tables("conv", "convp") + "SELECT seq, coalesce(tr, conv.text) AS shown FROM conv LEFT JOIN convp ON convp.text = conv.text")
def runtime_lookup(spark, sf_dir):
    return runtime.lookup(A.conversation_entries(spark, sf_dir), A.conversation_progress(spark, sf_dir)).select("seq", "shown")


@query(
    "runtime_counters",
    with_tables("conv", "convp")
    + "SELECT count(*) AS calls, count(tr) AS hits, coalesce(arg_max(conv.text, seq) FILTER (WHERE tr IS NULL), '') AS last_miss FROM conv LEFT JOIN convp ON convp.text = conv.text",
)
def runtime_counters(spark, sf_dir):
    return runtime.counters(A.conversation_entries(spark, sf_dir), A.conversation_progress(spark, sf_dir))


@query(
    "filter_chain",
    with_tables("conv", "convp")
    + "SELECT seq, CASE WHEN length(coalesce(tr, conv.text)) % 2 = 0 THEN '<' || coalesce(tr, conv.text) || '>' ELSE coalesce(tr, conv.text) END AS shown FROM conv LEFT JOIN convp ON convp.text = conv.text",
)
def filter_chain(spark, sf_dir):
    rows = qa.with_translations(A.conversation_entries(spark, sf_dir), A.conversation_progress(spark, sf_dir))
    earlier = lambda t: F.when(F.length(t) % 2 == 0, F.concat(F.lit("<"), t, F.lit(">")))
    return rows.select("seq", runtime.chained(F.col("text"), lambda t: F.col("tr"), earlier).alias("shown"))


def _arrays(spark, sf_dir) -> DataFrame:
    """One array a conversation and one for its second half, under the same key; the key of some is null."""
    rows = A.conversation_entries(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("s"))
    rows = rows.select("file", F.explode(F.array("s", F.filter("s", lambda x, k: k >= 3))).alias("s"))
    name = F.when(F.substring("file", -1, 1) != "7", F.col("file"))
    return rows.select(name.alias("file"), F.transform("s", lambda x: x["text"]).alias("said"), F.lit(2).alias("before"))


_NUMBERED = """FROM (SELECT *, unnest([0, 3]) AS half FROM (
  SELECT file, seq, conv.text, tr, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS p FROM conv LEFT JOIN convp ON convp.text = conv.text)) n
GROUP BY n.file, half"""
_NAMED = "CASE WHEN right(file, 1) <> '7' THEN file END AS file"


@query("array_translate", with_tables("conv", "convp") + f"SELECT {_NAMED}, md5(coalesce(string_agg(coalesce(tr, text), chr(10) ORDER BY seq) FILTER (WHERE p >= half), '')) AS said {_NUMBERED}")
def array_translate(spark, sf_dir):
    out = runtime.translate_arrays(_arrays(spark, sf_dir), A.conversation_progress(spark, sf_dir), "said")
    return out.select("file", F.md5(F.array_join("said", "\n")).alias("said"))


@query(
    "append_translate",
    with_tables("conv", "convp")
    + f"SELECT {_NAMED}, md5(coalesce(string_agg(CASE WHEN p - half >= 2 THEN coalesce(tr, text) ELSE text END, chr(10) ORDER BY seq) FILTER (WHERE p >= half), '')) AS said {_NUMBERED}",
)
def append_translate(spark, sf_dir):
    out = runtime.translate_arrays(_arrays(spark, sf_dir), A.conversation_progress(spark, sf_dir), "said", since="before")
    return out.select("file", F.md5(F.array_join("said", "\n")).alias("said"))
