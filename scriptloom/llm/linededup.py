"""Line deduplication by overlapping three-line windows.

Lines are what line feeds separate, trimmed of ASCII white space; lines without a
word are passed over. Each run of three consecutive lines of a document is hashed
(64 bits). Of the windows with equal content anywhere in the corpus, the first by
(doc_id, line) stays; every line that a later one covers is removed, overlapping
windows merging. Each removed line therefore has an equal line further ahead.
Documents with fewer than three lines have no window and stay as they are; so do
repeated passages that cover fewer than three whole lines, however long.

Aggregates and joins run on (hash, doc_id, line) only, which are written once below
the shared folder: the first window of each
hash comes from a partial aggregation, and hashes that occur once leave before
the join, whose hot keys adaptive execution splits. Texts are shuffled once.

The count of removed lines is called ``n_removed``, or as the caller says; an input column of that name is replaced.

Defined results: a null text stays null and has no lines; a document whose lines
all go has an empty text; a null doc_id is ordered first; rows with equal doc_id
are one document in the order of their text hash; extra columns are carried; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, shared_dir

EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    """Array of (p: place among all lines, h: hash of the trimmed line) of lines with a word."""
    parts = F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("p"), F.xxhash64(F.regexp_replace(x, EDGE, "")).alias("h"), x.rlike(WORD).alias("w")))
    return F.filter(parts, lambda x: x["w"])


def _windows(text: Column) -> Column:
    """Array of (h: hash of three lines, a, b: places of the first and last line)."""

    def of(lines: Column) -> Column:
        def window(i: Column) -> Column:
            return F.struct(
                F.xxhash64(F.get(lines, i)["h"], F.get(lines, i + 1)["h"], F.get(lines, i + 2)["h"]).alias("h"),
                F.get(lines, i)["p"].alias("a"),
                F.get(lines, i + 2)["p"].alias("b"),
            )

        return F.when(F.size(lines) >= 3, F.transform(F.sequence(F.lit(0), F.size(lines) - 3), window))

    return let(_lines(text), of)


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, spans: places of first and last line of later windows) of documents that lose lines."""
    windows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.explode(_windows(F.col("text"))).alias("w")).select("doc_id", "t", "w.h", "w.a", "w.b")
    windows = materialise(windows, f"{shared_dir(docs.sparkSession)}/windows")  # read twice, cut and hashed once
    place = F.struct("doc_id", "t", "a")
    first = windows.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "first")
    later = windows.join(first, "h").filter(place != F.col("first"))
    return later.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans as one, in one pass: sorted spans end in the order they begin."""

    def of(s: Column) -> Column:
        begins = F.filter(s, lambda x, k: (k == 0) | (x["a"] > F.get(s, k - 1)["b"] + 1))
        ends = F.filter(s, lambda x, k: (k == F.size(s) - 1) | (F.get(s, k + 1)["a"] > x["b"] + 1))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))

    return let(spans, of)


def _without(text: Column, spans: Column) -> Column:
    """The lines between the merged ``spans``; each is copied once, however long the text."""

    def between(lines: Column) -> Column:
        def part(k: Column) -> Column:
            begin = F.coalesce(F.get(spans, k - 1)["b"] + 1, F.lit(0))
            return F.slice(lines, begin + 1, F.coalesce(F.get(spans, k)["a"], F.size(lines)) - begin)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), part)), "\n")

    return let(F.split(text, "\n"), between)


def dedup_lines(docs: DataFrame, count: str = "n_removed") -> DataFrame:
    """``docs`` with the text after removal, plus ``count`` (lines gone)."""
    columns = [c for c in docs.columns if c != count]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64("text").alias("t"), F.col("doc_id").alias("d"))
    spans = covered_lines(docs).select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), _merged(F.col("spans")).alias("s"))
    joined = packed.join(spans, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    removed = F.coalesce(F.aggregate("s", F.lit(0), lambda n, x: n + x["b"] - x["a"] + 1), F.lit(0))
    own = lambda c: F.col("row").getField(c)
    text = F.when(F.col("s").isNull(), own("text")).otherwise(_without(own("text"), F.col("s")))
    return joined.select(*[(text if c == "text" else own(c)).alias(c) for c in columns], removed.cast("long").alias(count))
