"""Extraction of translatable strings from script lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.order import numbered
from ..model import NON_SPEAKERS
from ..shared import written


def with_layout(lines: DataFrame) -> DataFrame:
    """Add body (without indent), indent, blank and the line's role."""
    body = X.lstrip(F.col("raw"))
    out = lines.withColumn("body", body).withColumn("indent", F.length("raw") - F.length("body"))
    return out.select(
        "*",
        (F.col("body") == "").alias("blank"),
        X.matches(F.col("body"), X.PYTHON_HEADER).alias("python_header"),
        X.matches(F.col("body"), X.PYTHON_LINE).alias("python_line"),
        F.col("body").startswith("#").alias("comment"),
    )


#: Lines that are scanned together; longer files are cut, and each piece gets what the pieces before it left open.
CHUNK = 1 << 16
#: No block is open.
NONE = 2**31 - 1
#: Bits of a line, for the scan.
BLANK, OPENS, UNSEEN, PYTHON, SCREEN = 1, 2, 4, 8, 16


def scan_blocks(indent: np.ndarray, bits: np.ndarray, enter: int = NONE) -> tuple[np.ndarray, int, int]:
    """Which lines of a piece are inside a block, the least indent of its lines, and the least indent of a header left open.

    A block goes on to the next line that is not blank and not indented deeper than its
    header. ``enter`` is the least indent of a header that earlier pieces left open: of all
    open blocks the least indented one ends last, so that one number is all a piece needs to
    know of everything before it.
    """
    seen = (bits & UNSEEN) == 0
    solid = np.flatnonzero(seen & ((bits & BLANK) == 0))
    depth = indent[solid]
    heads = np.flatnonzero(seen & ((bits & OPENS) != 0))
    inside = np.zeros(len(indent), bool)

    def end_of(first: int, level: int) -> int:
        """Place among the solid lines, from ``first``, of the first one at most as deep as ``level``."""
        step = 64
        while first < len(depth):
            hit = np.flatnonzero(depth[first : first + step] <= level)
            if len(hit):
                return first + int(hit[0])
            first, step = first + step, step * 2
        return len(depth)

    at, left = 0, NONE
    if enter != NONE:
        k = end_of(0, enter)
        at = int(solid[k]) if k < len(solid) else len(indent)
        inside[:at], left = True, enter if k == len(solid) else NONE
    h = int(np.searchsorted(heads, at))
    while h < len(heads):
        head = int(heads[h])
        k = end_of(int(np.searchsorted(solid, head, side="right")), int(indent[head]))
        at = int(solid[k]) if k < len(solid) else len(indent)
        inside[head + 1 : at] = True
        if k == len(solid):
            left = int(indent[head])
            break
        h = int(np.searchsorted(heads, at))
    return inside & seen, int(depth.min()) if len(depth) else NONE, left


_PIECE = "key struct<file:string,chunk:bigint>, line array<int>, indent array<int>, bits array<int>, least int, left int"


def _pieces(batches: Iterator[pa.RecordBatch], settle: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces after ``settle`` (indent, bits, enter) has put its flags into bits."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            indent, bits = (row.column(row.schema.get_field_index(n)).flatten().to_numpy() for n in ("indent", "bits"))
            bits = settle(indent, bits, row.column(row.schema.get_field_index("enter"))[0].as_py())
            _, least, left = scan_blocks(indent, bits)
            line = row.column(row.schema.get_field_index("line"))
            arrays = [row.column(0), line, pa.array([indent], pa.list_(pa.int32())), pa.array([bits], pa.list_(pa.int32())), pa.array([least], pa.int32()), pa.array([left], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "line", "indent", "bits", "least", "left"])


def _entered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``enter``, what the earlier pieces of the file leave open; these meet as two numbers a piece."""
    ends = pieces.groupBy(F.col("key.file").alias("file")).agg(F.sort_array(F.collect_list(F.struct("key.chunk", "least", "left"))).alias("ends"))
    # least open indent after each piece: what came in, where nothing in the piece ended it, or what the piece leaves itself
    after = lambda s, x: F.when(s < x["least"], F.least(s, x["left"])).otherwise(x["left"])
    scan = F.aggregate("ends", F.struct(F.lit(NONE).alias("s"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct(after(a["s"], x).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")))
    each = ends.select("file", F.explode(F.arrays_zip(F.col("ends.chunk").alias("chunk"), scan["all"].alias("enter"))).alias("e"))
    return pieces.join(each.select(F.struct("file", "e.chunk").alias("key"), "e.enter"), "key")


def block_lines(lines: DataFrame, flags: Column, settles: list[Callable[[np.ndarray, np.ndarray, int], np.ndarray]]) -> DataFrame:
    """(file, line, bits) of lines, by passes over packed pieces of files: each of ``settles`` uses the blocks that the flags of the one before it open.

    Only indents and flags travel; a file is one row for each ``CHUNK`` line numbers. Lines
    are read once, and the rows of a piece are written below the shared folder between passes.
    """
    slim = lines.select(F.struct("file", F.floor(F.col("line") / CHUNK).alias("chunk")).alias("key"), F.struct("line", "indent", flags.alias("bits")).alias("x"))
    packed = slim.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pieces = packed.select("key", F.col("x.line").alias("line"), F.col("x.indent").alias("indent"), F.col("x.bits").alias("bits"), F.lit(NONE).alias("enter"))
    pieces = written(pieces.mapInArrow(lambda batches: _pieces(batches, lambda indent, bits, enter: bits), _PIECE))
    for settle in settles:
        pieces = written(_entered(pieces).mapInArrow(lambda batches, settle=settle: _pieces(batches, settle), _PIECE))
    each = pieces.select("key.file", F.explode(F.arrays_zip("line", "bits")).alias("x"))
    return each.select("file", "x.line", "x.bits")


def _python_then_screens(indent: np.ndarray, bits: np.ndarray, enter: int) -> np.ndarray:
    """After the blocks of Python headers are known: their lines, and all else that is no statement, are unseen from here on, and screen headers open."""
    inside, _, _ = scan_blocks(indent, bits, enter)
    hidden = inside | ((bits & (OPENS | HIDES)) != 0)
    out = bits & (BLANK | HEADS) | np.where(hidden, UNSEEN, 0) | np.where(inside, PYTHON, 0)
    return (out | np.where(~hidden & ((bits & HEADS) != 0), OPENS, 0)).astype(np.int32)


def _screens(indent: np.ndarray, bits: np.ndarray, enter: int) -> np.ndarray:
    return (bits | np.where(scan_blocks(indent, bits, enter)[0], SCREEN, 0)).astype(np.int32)


#: Further bits: a line that is hidden whatever surrounds it, and one that reads as a screen header.
HIDES, HEADS = 32, 64


def _bit(flag: Column, bit: int) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), bit).otherwise(0)


def inside_blocks(lines: DataFrame, header: Column) -> DataFrame:
    """(file, line) of lines inside a block that a ``header`` line opens."""
    found = block_lines(lines, _bit(F.col("blank"), BLANK) + _bit(header, OPENS), [_python_then_screens])
    return found.filter(F.col("bits").bitwiseAND(PYTHON) != 0).select("file", "line")


def masked(lines: DataFrame, screens: bool) -> DataFrame:
    """Lines with layout and the flags in_python and, in screens mode, in_screen and screen_header."""
    laid = with_layout(lines)
    flags = _bit(F.col("blank"), BLANK) + _bit(F.col("python_header"), OPENS) + _bit(F.col("python_line") | F.col("comment"), HIDES)
    if screens:
        flags = flags + _bit(X.matches(F.col("body"), X.SCREEN_HEADER), HEADS)
    found = block_lines(laid, flags, [_python_then_screens, _screens] if screens else [_python_then_screens])
    # most lines are in no block: only the others are joined
    bits = found.filter(F.col("bits").bitwiseAND(PYTHON | SCREEN) != 0).select(F.struct("file", "line").alias("_key"), "bits")
    out = laid.withColumn("_key", F.struct("file", "line")).join(bits, "_key", "left").drop("_key")
    has = lambda bit: F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    out = out.withColumns({"in_python": has(PYTHON), "in_screen": has(SCREEN)}).drop("bits")
    out = out.withColumn("hidden", F.col("in_python") | F.col("python_header") | F.col("python_line") | F.col("comment"))
    return out.withColumn("screen_header", ~F.col("hidden") & X.matches(F.col("body"), X.SCREEN_HEADER) if screens else F.lit(False))


def _row(pattern: str, text_group: int, kind: str, speaker: Column) -> tuple[Column, Column]:
    raw = F.col("raw")
    entry = F.struct(X.find(raw, pattern, text_group).alias("text"), speaker.alias("speaker"), F.lit(kind).alias("kind"))
    return X.matches(raw, pattern), entry


def statement() -> Column:
    """The one entry a visible line holds, by precedence: screen, show text, say, menu, narrator; null if none."""
    raw = F.col("raw")
    on_show, show = _row(X.SHOW_TEXT, 2, "text", F.lit("_text"))
    on_say, say = _row(X.SAY, 3, "say", X.find(raw, X.SAY, 2))
    on_menu, menu = _row(X.MENU, 2, "menu", F.lit("_menu"))
    on_narrator, narrator = _row(X.NARRATOR, 2, "narrator", F.lit("narrator"))
    on_screen, screen = _row(X.SCREEN_TEXT, 1, "screen", F.lit("_screen"))
    keyword = X.find(raw, X.SAY, 2).isin(*NON_SPEAKERS)
    inside = F.when(on_screen & X.translatable(X.find(raw, X.SCREEN_TEXT, 1)), screen)
    outside = F.when(on_show, show).when(on_say & ~keyword, say).when(on_menu, menu).when(on_narrator & (F.col("indent") > 0), narrator)
    return F.when(F.col("hidden") | F.col("screen_header"), None).when(F.col("in_screen"), inside).otherwise(outside)


def marked() -> Column:
    """All strings marked for translation on a line, from left to right."""
    one = lambda m: F.struct(F.concat(X.find(m, X.UI_TEXT, 1), X.find(m, X.UI_TEXT, 2)).alias("text"), F.lit("_ui").alias("speaker"), F.lit("ui").alias("kind"))
    found = F.transform(X.find_all(F.col("raw"), X.UI_MARK), one)
    kept = F.filter(found, lambda e: ~X.blank(e["text"]) & X.translatable(e["text"]))
    return F.when(F.col("comment"), F.array().cast("array<struct<text:string,speaker:string,kind:string>>")).otherwise(kept)


def occurrences(lines: DataFrame, screens: bool = False) -> DataFrame:
    """(text, speaker, file, line, kind, ord) of every entry; on a line marked strings come first."""
    single = F.filter(F.array(statement()), lambda e: e.isNotNull() & ~X.blank(e["text"]))
    entries = F.concat(marked(), single) if screens else single
    rows = masked(lines, screens).select("file", "line", F.posexplode(entries).alias("ord", "e"))
    return rows.select("e.text", "e.speaker", "file", "line", "e.kind", "ord")


def in_order(entries: DataFrame) -> DataFrame:
    """Add ``seq``: the place by file, line and order on the line."""
    return numbered(entries, ["file", "line", "ord"], "seq").drop("ord")


def first_occurrences(entries: DataFrame, key: str = "text") -> DataFrame:
    """The entry with the smallest ``seq`` of each text."""
    rest = [c for c in entries.columns if c not in (key, "seq")]
    first = entries.groupBy(key).agg(F.min(F.struct("seq", *rest)).alias("f"))
    return first.select(key, *[F.col(f"f.{c}").alias(c) for c in rest], F.col("f.seq").alias("seq"))


def extract(lines: DataFrame, screens: bool = False, dedupe: bool = True) -> DataFrame:
    """Entries of all lines in order; by default each text once."""
    out = in_order(occurrences(lines, screens))
    return first_occurrences(out) if dedupe else out


def per_file(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of each file, files without any included."""
    counts = entries.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return lines.select("file").distinct().join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n_strings"))


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("n_total"), F.countDistinct("text").alias("n_unique"))


def speakers(entries: DataFrame) -> DataFrame:
    return entries.select("speaker").distinct()


def subsystem_literals(lines: DataFrame) -> DataFrame:
    """Quoted strings of four or more characters on any line."""
    return lines.select("file", "line", F.explode(X.quoted_literals(F.col("raw"))).alias("text"))
