"""Token-id shards: one concatenated id array with Elias-Fano document boundaries.

Shard file: magic, the ids (2 or 4 bytes each, little-endian), the Elias-Fano
sequence of document ends (in ids), that of document ids (less their minimum),
then a fixed trailer. Documents are in ascending doc_id order within and across
shards. Ids are streamed to the file; a task holds only boundaries. A shard is
written under a name of its own attempt and renamed, so a repeated task after a
lost executor replaces it whole.

Defined results: a null text is empty (its document holds the end id only); null
ids come first and are kept as null; rows with equal ids are all kept, ordered by
their token ids; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, slices, texts_of
from .elias_fano import EliasFano
from .encode import encoder

MAGIC = b"LOOMEF01"
_TRAILER = struct.Struct("<QQQqQQB7x8s")


@dataclass(frozen=True)
class Shard:
    number: int
    path: str
    n_docs: int
    n_ids: int


class ShardWriter:
    def __init__(self, folder: str, number: int, width: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.target = f"{root}/shard-{number:06d}.efs"
        self.attempt = f"{root}/_attempt-{number:06d}-{uuid.uuid4().hex}"
        self.number, self.width, self.nulls, self.n_ids = number, width, 0, 0
        self.ends: list[int] = []
        self.docs: list[int] = []
        self.out = self.fs.open_output_stream(self.attempt)
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n_ids += len(ids) // self.width
        self.ends.append(self.n_ids)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> Shard:
        docs = np.array(self.docs, dtype=np.int64)
        least = int(docs[0]) if len(docs) else 0
        ends = EliasFano.build(np.array(self.ends, dtype=np.uint64)).to_bytes()
        names = EliasFano.build((docs.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))).to_bytes()
        self.out.write(ends)
        self.out.write(names)
        self.out.write(_TRAILER.pack(self.n_ids, len(ends), len(names), least, self.nulls, len(self.ends), self.width, MAGIC))
        self.out.close()
        self.fs.move(self.attempt, self.target)
        return Shard(self.number, self.target, len(self.ends), self.n_ids)


class ShardReader:
    def __init__(self, folder: str, path: str):
        self.file = pafs.FileSystem.from_uri(folder)[0].open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        self.n_ids, n_ends, n_names, self.least, self.nulls, self.n_docs, self.width, magic = _TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        at = size - _TRAILER.size - n_names - n_ends
        self.ends = EliasFano.from_bytes(self.file.read_at(n_ends, at))
        self.names = EliasFano.from_bytes(self.file.read_at(n_names, at + n_ends))

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        some = self.names.slice(max(a, self.nulls) - self.nulls, max(b, self.nulls) - self.nulls)
        return [None] * max(0, min(b, self.nulls) - a) + (some + self.least).tolist()

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a..b-1 begin, and where the last one ends."""
        first = self.ends.select(a - 1) if a else 0
        return np.concatenate([[first], self.ends.slice(a, b)])

    def ids(self, begin: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - begin) * self.width, len(MAGIC) + begin * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        begin = self.ends.select(i - 1) if i else 0
        return self.ids(begin, self.ends.select(i))


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int) -> list[Shard]:
    """Encode all texts and write shards in ascending doc_id order; the list grows with the partitions only."""
    spark = docs.sparkSession
    n = partitions(spark)
    probs = [k / (2 * n) for k in range(1, 2 * n)]
    cuts = docs.select(F.percentile_approx("doc_id", probs, 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = e.pack([end_id])
        for piece in (p for b in batches for p in slices(b)):
            ids = piece.column(0)
            plain = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            blobs = [x + end for x in e.encode(texts_of(piece.column(1)))]
            bucket = np.searchsorted(cuts, plain, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), ids, pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        width = encoder(path).width
        for b in batches:
            for bucket, doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if writer is None or writer.number != bucket:
                    if writer is not None:
                        done.append(writer.close())
                    writer = ShardWriter(folder, bucket, width)
                writer.add(doc_id, ids.as_buffer())
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist([s.__dict__ for s in done], schema=pa.schema([("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = docs.select("doc_id", "text").mapInArrow(encode, "bucket int, doc_id long, ids binary")
    # neighbouring buckets, of about equal rows, in each partition
    place = F.floor(F.col("bucket") * n / (len(cuts) + 1)).cast("int")
    rows = rows.withColumn("place", place).repartitionById(n, "place").drop("place").sortWithinPartitions("bucket", "doc_id", "ids")
    shards = rows.mapInArrow(write, "number int, path string, n_docs long, n_ids long").collect()
    return sorted((Shard(**r.asDict()) for r in shards), key=lambda s: s.number)


def read_shards(spark: SparkSession, folder: str, shards: list[Shard]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    base, rows = 0, []
    for s in shards:
        rows.append((s.path, base))
        base += s.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = ShardReader(folder, name)
                a = 0
                while a < reader.n_docs:
                    e = min(a + 512, reader.n_docs)
                    bounds = reader.bounds(a, e)
                    sums = []
                    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        sums.append(zlib.crc32(reader.ids(begin, end).astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids(a, e), pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = e

    return spark.createDataFrame(rows, "path string, base long").repartition(min(len(rows), 10 * partitions(spark))).mapInArrow(read, schema)


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the shards below the shared folder and return what the files hold."""
    folder = shared_dir(docs.sparkSession)
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, path, end_id))
