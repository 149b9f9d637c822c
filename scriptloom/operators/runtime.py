"""What deployed translations compute: lookup with fallback, counters, array and append shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


def lookup(rows: DataFrame, progress: DataFrame, active: bool = True) -> DataFrame:
    """Add ``shown``: the translation, or the text itself on a miss or while the language is not active."""
    if not active:
        return rows.withColumn("shown", F.col("text"))
    table = progress.select("text", F.col("tr").alias("_tr"))
    return rows.join(table, "text", "left").withColumn("shown", F.coalesce("_tr", "text")).drop("_tr")


def counters(rows: DataFrame, progress: DataFrame) -> DataFrame:
    """One row: calls, hits and the last text (by ``seq``) without a translation."""
    table = progress.select("text", F.lit(True).alias("_hit"))
    seen = rows.join(table, "text", "left")
    miss = F.when(F.col("_hit").isNull(), F.col("seq"))
    return seen.agg(F.count(F.lit(1)).alias("calls"), F.count("_hit").alias("hits"), F.coalesce(F.max_by("text", miss), F.lit("")).alias("last_miss"))


def chained(text: Column, translate: Callable[[Column], Column], previous: Callable[[Column], Column] | None = None) -> Column:
    """Translate first, then the earlier filter; null from either keeps what was there."""
    translated = F.coalesce(translate(text), text)
    return translated if previous is None else F.coalesce(previous(translated), translated)


def translate_arrays(rows: DataFrame, progress: DataFrame, column: str, since: str | None = None) -> DataFrame:
    """Translate the members of an array column; with ``since`` only those at that place or later.

    Members are looked up by a join, so the dictionary never has to fit a literal, and put
    back in order by row, not by any of its values: equal rows, repeated and null keys stay
    as many rows, null arrays and null members stay null.
    """
    others = [c for c in rows.columns if c != column]
    table = progress.select(F.col("text").alias("_m"), "tr")
    # numbers of rows are made once, and written: a task that runs again reads the same ones
    held = written(rows.select(F.monotonically_increasing_id().alias("_id"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{column}`").alias("_array")))
    flat = held.select("_id", "_row", F.col("_array").isNull().alias("_none"), F.posexplode_outer("_array").alias("_p", "_m"))
    # the other columns travel with the first member only
    flat = flat.withColumn("_from", F.col("_row").getField(since) if since else F.lit(0))
    flat = flat.withColumn("_row", F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("_row")))
    member = F.when(F.col("_p") >= F.col("_from"), F.coalesce("tr", "_m")).otherwise(F.col("_m"))
    found = flat.join(table, "_m", "left").groupBy("_id").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.bool_or("_none").alias("_none"), F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", member.alias("v"))))).alias("_s")
    )
    shown = F.when(~F.col("_none"), F.transform("_s", lambda x: x["v"]))
    return found.select(*[(shown if c == column else F.col("_row").getField(c)).alias(c) for c in rows.columns])


def missing_functions(wanted: list[str], present: set[str]) -> list[str]:
    """Names to wrap that do not exist, in order."""
    return [w for w in wanted if w not in present]
