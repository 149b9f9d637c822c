"""Project-shaped tables made from the test tables, in Spark and as DuckDB SQL.

The test tables hold no markup and no scripts, so both are synthesised by the same
deterministic rules on either side. ``SQL`` has one common table expression each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered, ranked
from ..shipping import ship_package
from ..sources.scripts import split_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, line, raw) of all document lines; the file is the source."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    lines = split_lines(docs.select(F.struct("doc_id", "source").alias("file"), F.col("text").alias("value")))
    return lines.select("file.doc_id", F.col("file.source").alias("file"), "line", "raw")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, raw): whole document lines, quotes and backslashes escaped, dressed as script statements."""
    lines = doc_lines(spark, sf_dir)
    placed = ranked(lines, F.floor(F.col("doc_id") / 4096), ["doc_id", "line"], "n", within=["file"])
    return placed.selectExpr("file", "CAST(n + 1 AS INT) AS line", f"{_escaped(34)} AS t", f"{_escaped(39)} AS u").selectExpr("file", "line", f"{_statement('div')} AS raw")


def _escaped(quote: int) -> str:
    """``raw`` for a literal in the quote of the given code."""
    return f"replace(replace(raw, chr(92), concat(chr(92), chr(92))), chr({quote}), concat(chr(92), chr({quote})))"


def _statement(div: str) -> str:
    deep = lambda n: f"repeat('    ', CAST((line {div} 13) % {n} AS INT))"
    return f"""CASE line % 13
      WHEN 0 THEN concat('    hero "', t, '"') WHEN 1 THEN concat('    "', t, '"') WHEN 2 THEN concat('    "', t, '" if ok:')
      WHEN 3 THEN concat('    show text "', t, '"') WHEN 4 THEN concat('    $ x = "', t, '"') WHEN 5 THEN concat({deep(3)}, 'python:')
      WHEN 6 THEN CASE WHEN (line {div} 13) % 3 = 0 THEN concat({deep(4)}, 'y = _(', chr(39), u, chr(39), ') + _("', t, '")') ELSE concat({deep(4)}, 'y = _("', t, '") + _("ok', line, '")') END WHEN 7 THEN concat('# _("', t, '")')
      WHEN 8 THEN concat({deep(2)}, 'screen s', line, ':') WHEN 9 THEN concat({deep(3)}, 'text "', t, '"')
      WHEN 10 THEN concat('        textbutton _("[x]") action "', t, '"') WHEN 11 THEN concat({deep(2)}, 'label "', t, '"')
      ELSE CASE WHEN (line {div} 13) % 2 = 0 THEN '' ELSE concat('extend "', t, '"') END END"""


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as entries: file c<id>, line is the turn."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    rows = rows.select("text", F.col("role").alias("speaker"), F.concat(F.lit("c"), "conv_id").alias("file"), F.col("turn").cast("int").alias("line"), F.lit("say").alias("kind"), "conv_id")
    return numbered(rows, ["conv_id", "line", "speaker"], "seq").drop("conv_id")


#: What an event says; those of every seventh user are thoughts in parentheses.
_SAID = "CASE WHEN user_id % 7 = 3 THEN concat('(', event_type, ' [u', user_id, '] ', props, ')') ELSE concat(event_type, ' [u', user_id, '] ', props) END"


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries with markup: file u<id>, two events on a line, kinds by id."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return (
        ranked(rows, F.date_trunc("day", "ts"), ["ts", "event_id"], "n", within=["user_id"])
        .selectExpr(
            f"{_SAID} AS text", "event_type AS speaker", "concat('u', user_id) AS file", "CAST((n + 1) div 2 AS INT) AS line",
            "CASE event_id % 5 WHEN 0 THEN 'screen' WHEN 1 THEN 'ui' ELSE 'say' END AS kind", "event_id AS seq",
        )
    )


def event_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, tr, pos) of the texts of events: by first id some are missing, blank, cut short or without markup."""
    first = event_entries(spark, sf_dir).groupBy("text").agg(F.min("seq").alias("pos"), F.min("speaker").alias("w"))
    return first.filter("pos % 11 <> 0").selectExpr("text", f"{_translated('substring(text, length(w) + 1)')} AS tr", "pos")


def _translated(rest: str) -> str:
    """``rest`` is the text behind its first word."""
    return f"""CASE pos % 11 WHEN 1 THEN '  ' WHEN 2 THEN substring(text, 1, 2)
      WHEN 3 THEN upper(w) ELSE concat(upper(w), {rest}) END"""


def conversation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = conversation_entries(spark, sf_dir).groupBy("text").agg(F.min("seq").alias("pos"))
    return first.filter("pos % 3 <> 0").selectExpr("text", "concat('» ', text) AS tr", "pos")


SQL = {
    "doc_lines": r"""doc_lines AS (
  SELECT doc_id, source AS file, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS raw,
         CAST(unnest(range(1, len(regexp_split_to_array(text, '\r\n|\r|\n')) + 1)) AS INT) AS line FROM documents WHERE text IS NOT NULL)""",
    "script": f"""script AS (
  SELECT file, line, {_statement("//")} AS raw FROM (
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY doc_id, line) AS INT) AS line, {_escaped(34)} AS t, {_escaped(39)} AS u FROM doc_lines))""",
    "conv": """conv AS (
  SELECT text, role AS speaker, 'c' || conv_id AS file, CAST(turn AS INT) AS line, 'say' AS kind,
         row_number() OVER (ORDER BY conv_id, turn, role) - 1 AS seq FROM conversations WHERE text IS NOT NULL)""",
    "ev": f"""ev AS (
  SELECT {_SAID} AS text, event_type AS speaker, concat('u', user_id) AS file,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) // 2 AS INT) AS line,
         CASE event_id % 5 WHEN 0 THEN 'screen' WHEN 1 THEN 'ui' ELSE 'say' END AS kind, event_id AS seq FROM events)""",
    "evp": f"""evp AS (
  SELECT text, {_translated("substring(text, length(w) + 1)")} AS tr, pos FROM (SELECT text, min(seq) AS pos, min(speaker) AS w FROM ev GROUP BY text) WHERE pos % 11 <> 0)""",
    "convp": "convp AS (SELECT text, concat('» ', text) AS tr, pos FROM (SELECT text, min(seq) AS pos FROM conv GROUP BY text) WHERE pos % 3 <> 0)",
}
NEEDS = {"script": ("doc_lines",), "evp": ("ev",), "convp": ("conv",)}


def with_tables(*names: str, more: str = "") -> str:
    """A WITH clause of the named tables and those they need."""
    ordered: list[str] = []
    for n in names:
        ordered += [x for x in (*NEEDS.get(n, ()), n) if x not in ordered]
    return "WITH " + ",\n".join([SQL[n] for n in ordered] + ([more] if more else [])) + "\n"
