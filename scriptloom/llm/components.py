"""Connected components by alternating large-star and small-star steps.

All state is distributed. The edges of one node are dealt by (node, salt of the other
end), with as many salts as shuffle partitions, and a node's minimum goes to those of
its salts that occur: a star that holds a third of all edges is no single task. Every
step is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, remove

MAX_STEPS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest b of a."""
    salts = partitions(edges.sparkSession)
    dealt = edges.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("s")).repartition("a", "s")
    parts = dealt.groupBy("a", "s").agg(F.min("b").alias("m"))
    # at most one entry a salt
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("s")).select("a", "m", F.explode("s").alias("s"))
    return dealt.join(least, ["a", "s"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a > b."""
    moved = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return _with_least(edges).select(moved.alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component: the smallest node it reaches) for every node of an edge (a, b) that reaches a smaller one."""
    spark = edges.sparkSession
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/cc-start")
    seen, last = None, f"{folder}/cc-start"
    for step in range(MAX_STEPS):
        path = f"{folder}/cc-{step}"
        current = materialise(_small_star(_large_star(current)), path)
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, last)
        last = path
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
