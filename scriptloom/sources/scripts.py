"""Script files as lines; entry and translation files; generated files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import numbered
from ..model import ENTRY
from ..shared import written
from . import files
from .members import read_members


#: Files above so many bytes are read by many tasks, split by split.
LARGE = 8 << 20
_BREAK = "\r\n|\r|\n"


def read_lines(spark: SparkSession, folder: str, glob: str = "*.rpy") -> DataFrame:
    """(file, line, raw) of the scripts directly in ``folder``.

    Bad bytes become U+FFFD, a byte order mark stays, and LF, CRLF and CR all end a line.
    A large file needs an LF now and then: what stands between two is one row.
    """
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "false")
    small = read.text(folder, wholetext=True).filter(F.col("_metadata.file_size") <= LARGE)
    lines = split_lines(small.select(F.col("_metadata.file_name").alias("file"), "value"))
    large = _large_lines(read.option("lineSep", "\n").text(folder).filter(F.col("_metadata.file_size") > LARGE))
    return lines if large is None else lines.unionAll(large)


def _large_lines(rows: DataFrame) -> DataFrame | None:
    """(file, line, raw) of files whose ``rows`` end at LFs; None without rows.

    A first pass counts the lines and bytes of each split; the driver gets one row a split,
    and with it where the lines of a split begin. The bytes also tell what the reader takes
    away: a byte order mark, and whether an LF is the last byte.
    """
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), "value")
    # a CR before the LF belongs to the break; one at the end of a file is put back below
    cr = F.endswith("value", F.lit("\r"))
    raw = F.split(F.when(cr, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")), "\r")
    place = F.monotonically_increasing_id()
    counted = rows.select("path", "file", "size", "start", F.octet_length("value").alias("bytes"), F.size(raw).alias("n"), cr.alias("cr"), place.alias("place"))
    splits = counted.groupBy("path", "file", "size", "start").agg(F.sum("n").alias("n"), F.sum(F.col("bytes") + 1).alias("bytes"), F.max_by("cr", "place").alias("cr")).collect()
    if not splits:
        return None
    first: dict[tuple[str, int], int] = {}
    marked, ends, last = set(), [], {}
    for s in sorted(splits, key=lambda s: (s["path"], s["start"])):
        n, size, _ = last.get(s["path"], (0, 0, s))
        first[s["path"], s["start"]] = n
        last[s["path"]] = (n + s["n"], size + s["bytes"], s)
    for path, (n, size, s) in last.items():
        lacking = s["size"] - size  # -1: no LF at the end; a mark is three bytes more
        if lacking > 0:
            marked.add((path, min(start for p, start in first if p == path)))
        if s["cr"] or lacking in (0, 3):
            ends.append((s["file"], n + 1, ""))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], int] = {}
        for batch in batches:
            paths, starts, lines = batch.column(0), batch.column(2).to_numpy(), batch.column(3)
            new = np.flatnonzero(np.diff(starts) != 0) + 1
            other = np.flatnonzero(np.asarray(pc.not_equal(paths[1:], paths[:-1]))) + 1 if batch.num_rows > 1 else new
            edges = sorted({0, *new.tolist(), *other.tolist(), batch.num_rows})
            for a, b in zip(edges, edges[1:], strict=False):
                key = (paths[a].as_py(), int(starts[a]))
                before, piece = done.get(key, 0), lines.slice(a, b - a)
                if not before and key in marked:
                    piece = pa.array(["\ufeff" + piece[0].as_py(), *piece[1:].to_pylist()], pa.string())
                done[key] = before + b - a
                at = first[key] + before + 1
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.arange(at, at + b - a), pa.int32()), piece], names=["file", "line", "raw"])

    # the regular expression of split makes bad bytes U+FFFD, as in small files
    found = rows.select("path", "file", "start", F.explode(raw).alias("raw")).mapInArrow(number, "file string, line int, raw string")
    return found.unionAll(rows.sparkSession.createDataFrame(ends, "file string, line int, raw string")) if ends else found


def split_lines(texts: DataFrame) -> DataFrame:
    """(file, value) to (file, line, raw)."""
    parts = F.split("value", _BREAK)
    return texts.select("file", F.posexplode(parts).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries, with its positions as ``seq``; a large file is read by many tasks."""
    rows = read_members(spark, path).select("place", F.from_json("member", ENTRY.simpleString()).alias("e"))
    return rows.select("e.*", F.col("place").alias("seq"))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object as (text, tr, pos); missing file: none. A repeated key keeps its first place and last value."""
    if not exists(spark, path):
        return spark.createDataFrame([], "text string, tr string, pos long")
    pair = F.from_json(F.concat(F.lit("{"), "member", F.lit("}")), "map<string,string>")
    rows = read_members(spark, path).select(F.col("place").alias("pos"), F.explode(pair).alias("text", "tr"))
    return rows.groupBy("text").agg(F.max_by("tr", "pos").alias("tr"), F.min("pos").cast("long").alias("pos"))


def _rendered_json(rows: DataFrame, of: Callable[[dict], str]) -> DataFrame:
    """Add ``value``: the row as indented JSON, by Python's encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([of(r) for r in batch.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "value"])

    schema = T.StructType([*rows.schema.fields, T.StructField("value", T.StringType())])
    return rows.mapInArrow(run, schema)


def _write_json(rows: DataFrame, of: Callable[[dict], str], path: str, brackets: str) -> int:
    """Rows with their place ``_n`` as members of one JSON array or object."""
    n = rows.count()
    members = _rendered_json(rows, of).select("_n", F.concat("value", F.when(F.col("_n") < n - 1, ",").otherwise("")).alias("value"))
    files.write_lines(members, ["_n"], path, brackets[0] + ("\n" if n else ""), brackets[1])
    return n


def write_entries(entries: DataFrame, path: str) -> int:
    """Export entries in ``seq`` order as an indented JSON array; executors write it."""

    def of(r: dict) -> str:
        return "  " + json.dumps({c: r[c] for c in ENTRY.names}, ensure_ascii=False, indent=2).replace("\n", "\n  ")

    return _write_json(numbered(entries.select("seq", *ENTRY.names), ["seq"], "_n"), of, path, "[]")


def write_progress(progress: DataFrame, path: str) -> int:
    """Export translations in ``pos`` order as an indented JSON object; executors write it."""
    of = lambda r: f"  {json.dumps(r['text'], ensure_ascii=False)}: {json.dumps(r['tr'], ensure_ascii=False)}"
    return _write_json(numbered(progress.select("pos", "text", "tr"), ["pos"], "_n"), of, path, "{}")


def write_rendered(rendered: DataFrame, folder: str) -> list[str]:
    """Write (path, ord, line) rows to the named files, in order."""
    return files.write_named(rendered, folder)


# ---- by the name of the path: JSON, or else Parquet, the store for large projects


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    return read_entries(spark, path) if path.endswith(".json") else spark.read.parquet(path).select(*ENTRY.names, F.col("seq").cast("long").alias("seq"))


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".json") or not exists(spark, path):
        return read_progress(spark, path)
    return spark.read.parquet(path).select("text", "tr", F.col("pos").cast("long").alias("pos"))


def _save(rows: DataFrame, path: str) -> int:
    kept = written(rows)  # the rows may come from the table that they replace
    kept.write.mode("overwrite").parquet(path)
    return kept.count()


def save_entries(entries: DataFrame, path: str) -> int:
    return write_entries(entries, path) if path.endswith(".json") else _save(entries.select(*ENTRY.names, "seq"), path)


def save_progress(progress: DataFrame, path: str) -> int:
    return write_progress(progress, path) if path.endswith(".json") else _save(progress.select("text", "tr", "pos"), path)
