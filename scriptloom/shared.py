"""Tables below the folder that the driver and all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``; it is removed when the driver ends.

    A setting without a scheme is a path of Spark's default file system, and the URI says so.
    Only where it (and the context's checkpoint folder) is unset and the driver runs all tasks
    itself is a temporary folder of this machine used.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(context, "_loom_scratch", None)
        if root is None:
            root = context._loom_scratch = "file://" + tempfile.mkdtemp(prefix="scriptloom-")
    path = f"{qualified(spark, root).rstrip('/')}/loom-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark reads and writes it in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` from a Parquet table below the shared folder."""
    path = path or f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
