"""Target-distribution importance resampling over hashed word runs, on persisted CSR blocks.

Words are ``[0-9a-z]`` and everything beyond ASCII, after lowering A-Z only; features are
all runs of 1 to ``longest`` words, joined by one space, in ``buckets`` buckets by crc32.
The document-by-bucket counts are written once below the shared folder as blocks of
compressed sparse rows (row ends, bucket numbers, counts as packed arrays). Column sums of
the blocks give the corpus' distribution, those of the target's blocks the target's; the
product of the blocks with the vector of gains (one number a bucket, which is the only thing
that the driver and the tasks hold of a table) gives each document's weight. Gumbel noise from
the document's id turns weights into scores, and the highest scores are drawn without
replacement.

A null text has no words; a document without a feature has weight 0. A null id is hashed as
``null`` and comes after all others in ties; of repeated rows each is a document of its own,
and rows that tie in everything are ordered by a hash. Extra columns are ignored; an empty
table gives no rows, an empty target has no features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import numbered
from .common import map_rows, materialise, shared_dir

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_REMEMBERED = 1 << 20
CSR = "ids array<bigint>, n_words array<bigint>, ends binary, columns binary, counts binary"


class Buckets(dict):
    """Bucket of each feature, computed once; forgets all where it would hold too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def csr_blocks(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Rows of counts of some documents each: ids, words, and (ends, columns, counts) of the sparse rows."""

    def run(batch: pa.RecordBatch, of: Buckets = Buckets(buckets)) -> pa.RecordBatch:  # noqa: B008  lives as long as the task's function
        sizes, n_words, found = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = WORDS.findall((text or b"").translate(_LOWER))
            n_words.append(len(words))
            before = len(found)
            for n in range(1, longest + 1):
                runs = words if n == 1 else [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
                found += map(of.__getitem__, runs)
            sizes.append(len(found) - before)
        row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        cells, counts = np.unique(row * buckets + np.array(found, np.int64), return_counts=True)
        ends = np.searchsorted(cells, np.arange(1, len(sizes) + 1, dtype=np.int64) * buckets)
        arrays = [pa.array([ends.astype("<i8").tobytes()]), pa.array([(cells % buckets).astype("<u4").tobytes()]), pa.array([counts.astype("<u4").tobytes()])]
        return pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64())), *arrays], names=["ids", "n_words", "ends", "columns", "counts"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, CSR)


def column_sums(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the features of all rows; a task adds up its blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for columns, counts in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                np.add.at(total, np.frombuffer(columns, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return blocks.select("columns", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of (t + 1)(S + buckets) / ((s + 1)(T + buckets))) of each bucket; one number a bucket reaches the driver."""
    sums = []
    for table in (corpus, target):
        vector = np.zeros(buckets, np.int64)
        for r in table.collect():
            vector[r["bucket"]] = r["n"]
        sums.append(vector)
    s, t = sums
    more = [float(int(x.sum()) + buckets) for x in sums]
    return np.array([math.floor(1000 * math.log((int(b) + 1) * more[0] / ((int(a) + 1) * more[1]))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sparse rows times the gains, as a floored mean over features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, *body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ends = np.frombuffer(body[0], "<i8")
                counts = np.frombuffer(body[2], "<u4").astype(np.int64)
                # running totals of features and of gains, taken at the ends of the rows
                totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (counts, counts * gain[np.frombuffer(body[1], "<u4")])]
                mean = np.where(totals[0] > 0, totals[1] // np.maximum(totals[0], 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, words, totals[0], mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "0") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` (from 1) of the drawn, else null.

    Of the documents with at least ``least_words`` words, floor(``percent`` / 100) of them with the highest scores are drawn.
    """
    folder = shared_dir(docs.sparkSession)
    blocks = materialise(csr_blocks(docs, longest, buckets), f"{folder}/csr")
    aims = csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aims, buckets), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed(blocks, gain).withColumn("score", F.col("weight") + noise)
    fits = F.col("n_words") >= least_words
    placed = numbered(scored.filter(fits), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    drawn = placed.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    names = ("doc_id", "n_features", "weight", "score")
    return placed.select(*names, rank.alias("rank")).unionAll(scored.filter(~fits).select(*names, F.lit(None).cast("long")))
