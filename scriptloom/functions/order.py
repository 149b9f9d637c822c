"""Row positions without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Places of a row in its partition in what monotonically_increasing_id gives; the partition is above them.
_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, bucket: Column, order: list, name: str, within: list[str]) -> DataFrame:
    """Number rows from 0 in the order of (``bucket``, ``order``) in each group of ``within``.

    Rows are numbered within their bucket, and buckets start after the rows of all
    earlier ones: a window beyond one bucket runs over one row for each bucket of its group only.
    """
    # a struct is never null and equal where its fields are, so rows with null keys are numbered too, and the join
    # finds its rows partitioned and sorted by the window
    keyed = df.withColumn("_bucket", F.struct(*within, bucket.alias("_b")))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[F.col("_bucket").getField(c) for c in within]).orderBy("_bucket")
    starts = counts.select("_bucket", (F.sum("_n").over(earlier) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    out = keyed.withColumn("_inside", inside).join(starts, "_bucket")
    return out.select(*df.columns, (F.col("_start") + F.col("_inside")).cast("long").alias(name))


def free(name: str, df: DataFrame) -> str:
    """``name``, with more underscores ahead where ``df`` has such a column (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number all rows from 0 in the order of the columns ``order``; rows that tie there are ordered by a hash of all columns.

    Rows are dealt by sampled ranges of the whole key (ties too, so no value is one task's
    alone), sorted in their partition, and written below the shared folder with their place in
    the partition. A count for each partition, which is all that the driver gets, says where each
    partition begins. The rows are computed once, when this is called; their numbers never change after.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # the hash comes first as a column, so that the ranges and the sort read one value
    last, place = free("_tie", df), free("_place", df)
    tie = df.withColumn(last, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = tie.repartitionByRange(parts, *keys, last).sortWithinPartitions(*keys, last)
    held = written(sorted_.select(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id().alias(place)))
    part = F.shiftright(place, 33).cast("int")
    counts = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(str(total))
        total += counts.get(p, 0)
    first = F.get(F.split(F.lit(",".join(starts)), ",").cast("array<bigint>"), part)  # a constant after folding
    return held.select(*[F.col(f"`{c}`") for c in df.columns], (first + F.col(place).bitwiseAND(F.lit(_PLACE))).alias(name))
