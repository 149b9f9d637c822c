"""Translations as they arrive: Parquet tables of one write each below a shared folder, the newest of a text wins.

A write becomes visible at once and whole, with the mark that Spark's committer leaves when
all its files are there. ``FAN`` tables of one level are put together as one of the next, so
that each row is written again once a level: n writes cost n log n rows, not n squared. A table
that another one covers is not read and goes at the next write, so that a crash between any two
steps loses nothing and counts nothing twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PROGRESS

FAN = 8
_NAME = re.compile(r"t(\d+)-(\d+)-(\d+)$")


def shared_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI; a path of this machine alone is refused where executors are on others."""
    import os

    if "://" in folder or folder.startswith("file:"):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a path of one machine; name a folder that the driver and all executors share, as a URI")
    return "file://" + os.path.abspath(folder)


class ProgressStore:
    """Translations (text, tr, pos) by the number of the write that brought them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, shared_uri(spark, folder)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _tables(self) -> list[tuple[int, int, int]]:
        """(level, first write, last write) of all complete tables."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        found = [tuple(map(int, m.groups())) for m in map(_NAME.match, names) if m]
        return sorted(t for t in found if self._fs.exists(self._path(f"{self._at(t)}/_SUCCESS")))

    def _at(self, table: tuple[int, int, int]) -> str:
        return f"{self.folder}/t{table[0]}-{table[1]}-{table[2]}"

    def live(self) -> list[tuple[int, int, int]]:
        """The tables that no other one covers, in the order of their writes."""
        every = self._tables()
        covered = lambda t: any(o[0] > t[0] and o[1] <= t[1] and t[2] <= o[2] for o in every)
        return sorted((t for t in every if not covered(t)), key=lambda t: t[1])

    def next_number(self) -> int:
        return max((t[2] + 1 for t in self._tables()), default=0)

    def _versions(self, tables: list[tuple[int, int, int]]) -> DataFrame:
        """(text, tr, pos, v: number of the write) of the newest of each text, at the place of the first."""
        rows = self.spark.createDataFrame([], f"{PROGRESS}, v long")
        if tables:
            rows = self.spark.read.schema(f"{PROGRESS}, v long").parquet(*map(self._at, tables))
        return rows.groupBy("text").agg(F.max_by("tr", F.struct("v", "pos")).alias("tr"), F.min_by("pos", F.struct("v", "pos")).alias("pos"), F.max("v").alias("v"))

    def read(self) -> DataFrame:
        return self._versions(self.live()).select("text", "tr", "pos")

    def append(self, new: DataFrame, number: int | None = None) -> int:
        """Add a write; one that is repeated under its number replaces itself."""
        number = self.next_number() if number is None else number
        table = (0, number, number)
        new.select("text", "tr", "pos", F.lit(number).cast("long").alias("v")).write.mode("overwrite").parquet(self._at(table))
        self._merge()
        return number

    def _merge(self) -> None:
        level = 0
        while True:
            mine = [t for t in self.live() if t[0] == level]
            if len(mine) >= FAN:
                self._versions(mine).write.mode("overwrite").parquet(self._at((level + 1, mine[0][1], mine[-1][2])))
            elif not any(t[0] > level for t in self.live()):
                break
            level += 1
        live = set(self.live())
        for t in self._tables():
            if t not in live:
                self._fs.delete(self._path(self._at(t)), True)

    def clear(self) -> None:
        self._fs.delete(self._path(self.folder), True)
