"""Files of an exact name and order, written by executors and joined by one commit.

Executors write ranges of the sorted rows as part files below the shared folder, under Spark's
own commit protocol, so that lost or repeated tasks leave nothing. The commit copies the parts'
bytes one after another to a draft beside the target and gives it the target's name at the end:
a reader sees the old file or the new one, and a run that fails before that leaves the old one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


class _Store:
    """A file system by path; paths without a scheme are files of the driver's machine."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.uri = path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
        self.path = self.jvm.org.apache.hadoop.fs.Path(self.uri)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list:
        """Part files below a folder that Spark wrote, in order."""
        found = [s.getPath() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []
        return sorted((p for p in found if p.getName().startswith("part-")), key=lambda p: p.getName())


def join_parts(spark: SparkSession, folder: str, target: str, head: str = "", tail: str = "") -> None:
    """Commit: ``head``, the parts in ``folder`` and ``tail`` become the file ``target``; bytes are copied, no row is read."""
    source, end = _Store(spark, folder), _Store(spark, target)
    end.fs.mkdirs(end.path.getParent())
    end.fs.setWriteChecksum(False)
    draft = end.jvm.org.apache.hadoop.fs.Path(end.path.getParent(), f".{end.path.getName()}.{uuid.uuid4().hex}")
    try:
        out = end.fs.create(draft)
        try:
            out.write(bytearray(head.encode("utf-8")))
            for part in source.parts():
                stream = source.fs.open(part)
                try:
                    end.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    stream.close()
            out.write(bytearray(tail.encode("utf-8")))
        finally:
            out.close()
        options = spark.sparkContext._gateway.new_array(end.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = end.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = end.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else end.path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, end.path, options)
    finally:
        end.fs.delete(draft, False)
        end.fs.setWriteChecksum(True)


def write_lines(rows: DataFrame, order: list[str], target: str, head: str = "", tail: str = "") -> None:
    """The column ``value`` of ``rows``, in the order of the columns ``order``, one line each, as the file ``target``."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/parts"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the order's columns only sort; ranges of them are the parts
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.text(folder)
    join_parts(spark, folder, target, head, tail)


def write_named(rows: DataFrame, folder: str) -> list[str]:
    """Rows (path, ord, line) as the files they name below ``folder``; only the names reach the driver."""
    spark = rows.sparkSession
    work = f"{shared_dir(spark)}/parts"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted by the folder's name first, as the writer wants it: else it would sort again, and lose the order of the lines
    named = rows.select(F.col("line").alias("value"), F.md5("path").alias("name"), "ord")
    named = named.repartitionByRange(parts, "name", "ord").sortWithinPartitions("name", "ord").select("value", "name")
    names = [r["path"] for r in rows.select("path").distinct().orderBy("path").toLocalIterator()]
    named.write.partitionBy("name").text(work)
    out = []
    digests = spark.createDataFrame([(n,) for n in names], "path string").select("path", F.md5("path").alias("name")).collect() if names else []
    for r in sorted(digests, key=lambda r: r["path"]):
        target = f"{folder.rstrip('/')}/{r['path']}"
        join_parts(spark, f"{work}/name={r['name']}", target)
        out.append(target)
    return out
