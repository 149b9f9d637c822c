"""Packing along a space-filling curve.

Each document becomes a signed feature-hashed vector of its token ids, which a
fixed random projection maps to four dimensions; the Hilbert key of that point
orders the corpus so that like documents are neighbours. The order is made by a
range partition (cells of the key, from a histogram of bounded size; cells with
more than a share of the tokens are split by a hash). The token stream in this
order is cut into sequences of ``length`` tokens; the tail becomes sequences of
falling powers of two, so nothing is padded.

Defined results: a null or empty text is its end id alone; null ids, ties and
repeated rows are packed like any other row (rows of one id and one cell are not
split, as the hash is of the id); extra columns, whatever their names, are ignored;
an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, mix64, partitions, seeds64, shared_dir, texts_of
from .encode import encoder

DIMS, BITS, HASHED, TIE_BITS, CELL_BITS = 4, 8, 256, 20, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache
def _tables(n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket (twice the dimensions: sign in the lowest bit) of each id; the projection."""
    bucket = (mix64(np.arange(n_ids, dtype=np.uint64) * seeds64(1, 7)[0] + np.uint64(11)) >> np.uint64(40)) % np.uint64(2 * HASHED)
    h = mix64(np.arange(HASHED * DIMS * 2, dtype=np.uint64) + np.uint64(101)).astype(np.float64) / 2**64 + 1e-12
    gauss = np.sqrt(-2 * np.log(h[: HASHED * DIMS])) * np.cos(2 * np.pi * h[HASHED * DIMS :])
    return bucket.astype(np.int64), gauss.reshape(HASHED, DIMS)


def points(ids: list[np.ndarray]) -> np.ndarray:
    """Integer coordinates (documents x DIMS, BITS bits each)."""
    bucket, projection = _tables(1 << 17)
    counts = np.stack([np.bincount(bucket[x], minlength=2 * HASHED) for x in ids]).astype(np.float64)
    vectors = np.sqrt(counts[:, 0::2]) - np.sqrt(counts[:, 1::2])
    norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    scaled = 0.5 + 0.25 * (vectors / norm) @ projection
    return np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows); exchange and inversion per bit, then a Gray decode."""
    x = x.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


def _encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        end = e.pack([end_id])
        blobs = [x + end for x in e.encode(texts_of(batch.column(1)))]
        arrays = [np.frombuffer(x, f"<u{e.width}") for x in blobs]
        doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tie = mix64(doc.view(np.uint64) + np.uint64(17)) >> np.uint64(64 - TIE_BITS)
        key = (hilbert(points(arrays)) << np.uint64(TIE_BITS)) | tie
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(key.astype(np.int64)), pa.array([len(x) for x in arrays], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "key", "n", "ids"]
        )

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, key long, n long, ids binary")


def _plan(cells: list[tuple[int, int]], buckets: int) -> list[tuple[int, int, int]]:
    """(cell, first bucket, buckets) of each cell in key order, for ``buckets`` ranges of about equal tokens."""
    total = sum(n for _, n in cells)
    share = max(1, -(-total // max(1, buckets)))
    out, at, filled = [], 0, 0
    for cell, n in sorted(cells):
        if n > share:
            if filled:
                at, filled = at + 1, 0
            k = -(-n // share)
            out.append((cell, at, k))
            at += k
        else:
            if filled + n > share:
                at, filled = at + 1, 0
            out.append((cell, at, 1))
            filled += n
    return out


def _ends(total: int, length: int) -> np.ndarray:
    """Where the sequences of the tail end: falling powers of two after the last full sequence."""
    at, out = total // length * length, []
    for b in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> b & 1:
            at += 1 << b
            out.append(at)
    return np.array(out, dtype=np.int64)


def cut(position: int, n: int, total: int, length: int, tail: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pieces (start, length, sequence, offset) of a document of ``n`` tokens at ``position`` of the stream."""
    out, at, end, full = [], position, position + n, total // length * length
    while at < end:
        if at < full:
            sequence, offset = divmod(at, length)
            stop = (sequence + 1) * length
        else:
            k = int(np.searchsorted(tail, at, side="right"))
            sequence, stop = full // length + k, int(tail[k])
            offset = at - (int(tail[k - 1]) if k else full)
        stop = min(stop, end)
        out.append((at - position, stop - at, sequence, offset))
        at = stop
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = 1024) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    encoded = materialise(_encode(docs, path, end_id), f"{shared_dir(spark)}/ids")
    cell = F.shiftrightunsigned("key", DIMS * BITS + TIE_BITS - CELL_BITS)
    cells = [(r["cell"], r["n"]) for r in encoded.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect()]  # at most 2^CELL_BITS rows
    if not cells:
        return spark.createDataFrame([], PIECES)
    plan = F.broadcast(spark.createDataFrame(_plan(cells, 2 * n_parts), "cell long, first int, parts int"))
    tie = F.col("key").bitwiseAND((1 << TIE_BITS) - 1)
    placed = encoded.withColumn("cell", cell).join(plan, "cell")
    placed = placed.withColumn("bucket", (F.col("first") + F.shiftright(tie * F.col("parts"), TIE_BITS)).cast("int")).drop("cell", "first", "parts")
    sizes = dict(placed.groupBy("bucket").agg(F.sum("n")).collect())  # one row per bucket
    base, total = {}, 0
    for b in sorted(sizes):
        base[b], total = total, total + sizes[b]
    tail = _ends(total, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(path).width
        bucket, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for b, doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b != bucket:
                    bucket, at = b, base[b]
                plain = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")
                for start, size, sequence, offset in cut(at, n, total, length, tail):
                    rows.append((doc_id, start, size, zlib.crc32(plain[start : start + size].tobytes()), n, sequence, offset))
                at += n
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # neighbouring buckets, of about equal tokens, in each partition
    place = F.floor(F.col("bucket") * n_parts / (max(sizes) + 1)).cast("int")
    ordered = placed.select("bucket", "doc_id", "n", "ids", "key", place.alias("place")).repartitionById(n_parts, "place").sortWithinPartitions("bucket", "key", "doc_id", "ids")
    return ordered.drop("place").mapInArrow(run, PIECES)
