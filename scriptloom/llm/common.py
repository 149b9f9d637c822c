"""Shared folder, materialisation, batching and hashing helpers of the llm operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words: U+0020 and U+0009-U+000D.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``.

    The setting (or else the checkpoint folder set on the context) names a folder that
    all executors share; without a scheme it is a path of Spark's default file system, and
    the URI says so. Only where both are unset and the driver runs all tasks itself
    (local runs and tests) is a temporary folder of this machine used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_loom_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="scriptloom-")
            spark.sparkContext._loom_shared = root
    path = f"{qualified(spark, root).rstrip('/')}/loom-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark reads and writes it in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, path: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` (with more options of the writer) and read it back: cuts lineage in a form that outlives executors."""
    df.write.options(**options or {}).option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, path: str) -> DataFrame:
    """:func:`materialise`, and the shuffle files behind it go as soon as the table is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return materialise(df, path)
    finally:
        spark.conf.set(_CLEAN, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Apply ``fn`` to pieces of Arrow batches; a piece holds at most about 4 MB of text and at least one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                out = fn(piece)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its variable-length data pass ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    weight = np.full(batch.num_rows, 8, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            weight += binary_lengths(column)
    group = np.cumsum(weight) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def binary_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds64(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend only on ``seed``."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _ODD) | np.uint64(1)


def crc32_mod(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % modulus
