"""Exact substring deduplication by difference-cover suffix sorting, one suffix bucket at a time.

Every byte is removed that a ``length``-byte string covers which also starts in a document
with a smaller id. Only the order of suffixes to that depth matters, so that:

1. Chunks. Of equal texts (by 128 bits) only the one with the smallest id goes on, as the
   others are covered whole. Documents become chunks, written once below the shared folder; texts
   of a chunk lie end to end, in the order of their ids.
2. Cover sample. With the difference cover {0, 1, 3, 9} modulo 13, any two positions have an offset
   below 13 at which both are in the sample. The first ``length`` - 12 bytes of each sample suffix
   are ranked: their hashes meet in buckets, each sorted on its own, and chunks are told which
   occur more than once. A rank that occurs once needs no more work, which most do.
3. Suffix buckets. The suffixes that reach a rank after 0 to 12 bytes form its bucket, which gets
   for each occurrence only the 12 bytes before and the 12 bytes after: between these, suffixes
   with one rank at one offset tie over ``length`` - 12 bytes, and the rank decides that tie
   without a look at the bytes. So each bucket is sorted, one after another and offset by offset,
   by (rank, bytes before, bytes after); equal neighbours are equal strings, and those that have a
   smaller id among them are marked. By the cover, each pair of equal strings meets somewhere.
4. Chunks collect the marks, and cut the covered runs.

Equal occurrences of a chunk go to their bucket as one (the smallest id first), so a string in a
third of all documents is one row a chunk. A bucket of ranks is a share of the sample (4 bytes a
sample string) and held in one task: give shuffle partitions in proportion to the data. Sample
strings are known by 64 bits of hash beside their bucket, and all else is compared byte by byte.

A null text is empty; texts shorter than ``length`` bytes stay. Rows of one id are one document
(they remove nothing from each other), and a null id is smaller than all others. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, settled, shared_dir, slices

#: Period and difference cover: every number is a difference of two members, modulo the period.
PERIOD, COVER = 13, (0, 1, 3, 9)
REACH = PERIOD - 1
#: Bytes of text in a chunk (a longer text is one chunk), and buckets of a shuffle partition.
CHUNK_BYTES, SPLIT = 4 << 20, 1
LEAST_ID = -(2**63)
CHUNKS = "chunk long, ids array<bigint>, prints array<binary>, sizes array<bigint>, body binary"


def first_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, f: 128 bits of it) of each distinct text, with its smallest id (null as the least long)."""
    named = docs.select(_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("f", _print())
    return named.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "f")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))


def _print() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of some documents each: ids in order, fingerprints and bytes of each text, and the texts end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids are those of one written table: a task that runs again replaces its rows whole
        first, made, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            ids, texts, prints = zip(*held, strict=True)
            columns = [(ids, pa.list_(pa.int64())), (prints, pa.list_(pa.binary())), (list(map(len, texts)), pa.list_(pa.int64())), (b"".join(texts), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *[pa.array([c], k) for c, k in columns]], names=["chunk", "ids", "prints", "sizes", "body"])

        for batch in batches:
            for piece in slices(batch):
                for d, text, f in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    if held and size + len(text) > CHUNK_BYTES:
                        yield flush()
                        made, size, held = made + 1, 0, []
                    held.append((d, text, f))
                    size += len(text)
        if held:
            yield flush()

    return docs.mapInArrow(run, CHUNKS)


class Sample:
    """The sample suffixes of a chunk that leave room for a rank, and the hash of their first bytes."""

    def __init__(self, sizes: list[int], body: bytes, length: int, buckets: int):
        self.size = length - REACH
        sizes = np.array(sizes, np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.end = self.begin + sizes
        room = np.maximum(sizes - self.size + 1, 0)
        rows = -(-room // PERIOD)
        doc = np.repeat(np.arange(len(sizes)), rows)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * PERIOD
        inside = (first[:, None] + np.array(COVER)[None, :]).ravel()
        doc = np.repeat(doc, len(COVER))
        fits = inside < room[doc]
        self.doc, self.at = doc[fits], (self.begin[doc] + inside)[fits]
        # eight bytes at any place, as a number
        self.bytes = np.frombuffer(body + bytes(16), np.uint8)
        self.h = np.full(len(self.at), 0x9E3779B97F4A7C15, np.uint64)
        for k in [*range(0, self.size - 7, 8), self.size - 8]:
            self.h = mix64(self.h * np.uint64(0xD6E8FEB86659FD93) + self.eight(self.at + k))
        spread = mix64(self.h ^ np.uint64(0xC0FFEE))
        self.bucket = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.short = (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.key = (self.bucket.astype(np.uint64) << np.uint64(32)) | self.short

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(short: sorted distinct hashes, several: whether they occur more than once here, cuts of the buckets)."""
        key = np.sort(self.key)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        key = key[first]
        return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.diff(np.append(first, len(new))) > 1, self._cuts(key, buckets)

    @staticmethod
    def _cuts(key: np.ndarray, buckets: int) -> np.ndarray:
        return np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))

    def eight(self, at: np.ndarray) -> np.ndarray:
        flat = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes.data, strides=(1,))
        return flat[at]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by bucket, one bucket after another in a partition."""
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "chunk")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows) of sorted rows; the bucket is the first column."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at:
                if held:
                    yield at, held
                held, at = [], row[0]
            held.append(row[1:])
    if held:
        yield at, held


REPLY = "chunk long, bucket int, body binary"


def _reply(chunk: int, bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], names=["chunk", "bucket", "body"])


def repeated_ranks(table: DataFrame, length: int, buckets: int) -> DataFrame:
    """(chunk, bucket, body: hashes of the chunk's sample strings of the bucket that occur more than once, sorted)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Sample(sizes, body, length, buckets)
                short, several, cuts = s.distinct(buckets)
                some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                keys = [short[cuts[b] : cuts[b + 1]].astype("<u4").tobytes() for b in some]
                flags = [np.packbits(several[cuts[b] : cuts[b + 1]]).tobytes() for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(keys, pa.binary()), pa.array(flags, pa.binary())], names=["bucket", "chunk", "keys", "several"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
            several = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(r[1]) // 4) for r in rows])
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            live = several > 0
            live[order[1:][same]] = True
            live[order[:-1][same]] = True
            begin = 0
            for chunk, body, _ in rows:
                mine = slice(begin, begin + len(body) // 4)
                begin = mine.stop
                if live[mine].any():
                    yield _reply(chunk, bucket, keys[mine][live[mine]].tobytes())

    rows = table.select("chunk", "sizes", "body").mapInArrow(sample, "bucket int, chunk long, keys binary, several binary")
    # a string that several chunks flag, or one of them more than once, stays flagged for all: the flag is of the string
    return _dealt(rows).mapInArrow(meet, REPLY)


def _among(keys: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Places of those of ``keys`` that are among the sorted ``few``; a table of bits passes over most of the others."""
    mask = np.uint64((1 << 22) - 1)
    table = np.zeros(1 << 22, bool)
    table[(few & mask).astype(np.int64)] = True
    some = np.flatnonzero(table[(keys & mask).astype(np.int64)])
    at = np.minimum(np.searchsorted(few, keys[some]), max(len(few) - 1, 0))
    return some[few[at] == keys[some]] if len(few) else some


class Suffixes:
    """The occurrences of repeated ranks in a chunk, with what is before and after each."""

    def __init__(self, sizes: list[int], body: bytes, replies: list, length: int, buckets: int):
        s = self.sample = Sample(sizes, body, length, buckets)
        told = [np.frombuffer(r["body"], "<u4") | (np.uint64(r["bucket"]) << np.uint64(32)) for r in sorted(replies, key=lambda r: r["bucket"])]
        pick = _among(s.key, np.concatenate(told) if told else np.zeros(0, np.uint64))
        self.at, self.doc = s.at[pick], s.doc[pick]
        name = s.h[pick]
        self.left = np.minimum(self.at - s.begin[self.doc], REACH)
        self.right = np.minimum(s.end[self.doc] - self.at - s.size, REACH)
        # the 12 bytes on either side, nearest first; beyond the text they are 0, and the lengths tell
        k = np.arange(REACH)
        sides = np.zeros((len(pick), 2 * REACH), np.uint8)
        sides[:, :REACH] = np.where(self.left[:, None] > k, s.bytes[np.maximum(self.at[:, None] - 1 - k, 0)], 0)
        sides[:, REACH:] = np.where(self.right[:, None] > k, s.bytes[np.minimum(self.at[:, None] + s.size + k, len(s.bytes) - 1)], 0)
        self.sides, self.name, self.bucket = sides, name, s.bucket[pick]
        packed = sides.view("<u8").reshape(len(pick), 3)
        # equal occurrences as one, by a hash that only brings them together: neighbours are compared whole
        columns = [name, packed[:, 0], packed[:, 1], packed[:, 2], (self.left * 16 + self.right).astype(np.uint64)]
        h = np.zeros(len(pick), np.uint64)
        for c in columns:
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + c)
        order = np.argsort((self.bucket.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), kind="stable")
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        self.first = order[new]
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.cuts = np.searchsorted(self.bucket[self.first], np.arange(buckets + 1))


def marked(name: np.ndarray, sides: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Bits of each occurrence: bit k is on where the string that begins k bytes before it also begins in a smaller document.

    The suffixes of a bucket, offset by offset: sorted by rank and by the k bytes before and the ``REACH`` - k bytes after.
    """
    out = np.zeros(len(name), np.uint16)
    _, rank, n = np.unique(name, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(n[rank] > 1)  # the others have nothing to be compared with
    rank = rank.astype(np.uint64) << np.uint64(32)
    for k in range(REACH + 1):
        some = open_[(left[open_] >= k) & (right[open_] >= REACH - k)]
        if len(some) < 2:
            continue
        around = np.zeros((len(some), 16), np.uint8)
        around[:, :k] = sides[some, :k]
        around[:, k:REACH] = sides[some, REACH : 2 * REACH - k]
        words = around.view("<u8")
        near, far = words[:, 0], rank[some] | words[:, 1]  # the last 4 of the 12 bytes and the rank are one number
        order = np.lexsort((near, far))
        near, far, mine = near[order], far[order], ids[some][order]
        new = np.ones(len(order), bool)
        new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        begin = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(mine, begin), np.diff(np.append(begin, len(order))))
        out[some[order[mine > least]]] |= np.uint16(1 << k)
    return out


def later_strings(table: DataFrame, replies: DataFrame, length: int, buckets: int) -> DataFrame:
    """(chunk, bucket, body: marks of the chunk's distinct occurrences of repeated ranks)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, sizes, body, told in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x = Suffixes(sizes, body, told, length, buckets)
                ids = np.array(ids, np.int64)[x.doc[x.first]] if len(x.first) else np.zeros(0, np.int64)
                some = [b for b in range(buckets) if x.cuts[b] < x.cuts[b + 1]]
                lengths = (x.left * 16 + x.right).astype("<u1")
                columns = [x.name[x.first].astype("<u8"), x.sides[x.first], lengths[x.first], ids.astype("<i8")]
                arrays = [pa.array([c[x.cuts[b] : x.cuts[b + 1]].tobytes() for b in some], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), *arrays], names=["bucket", "chunk", "name", "sides", "lengths", "ids"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            name, sides, lengths, ids = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((1, "<u8"), (2, "u1"), (3, "u1"), (4, "<i8")))
            bits = marked(name, sides.reshape(-1, 2 * REACH), (lengths >> 4).astype(np.int64), (lengths & 15).astype(np.int64), ids, length)
            begin = 0
            for r in rows:
                mine = bits[begin : begin + len(r[3])]
                begin += len(mine)
                yield _reply(r[0], bucket, mine.astype("<u2").tobytes())

    told = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("told"))
    rows = table.join(told, "chunk").select("chunk", "ids", "sizes", "body", "told").mapInArrow(deal, "bucket int, chunk long, name binary, sides binary, lengths binary, ids binary")
    return _dealt(rows).mapInArrow(sort, REPLY)


def spans(x: Suffixes, ids: np.ndarray, marks: list, length: int) -> np.ndarray:
    """Covered bytes of a chunk, as flags."""
    bits = np.zeros(len(x.first), np.uint16)
    for m in marks:
        bits[x.cuts[m["bucket"]] : x.cuts[m["bucket"] + 1]] = np.frombuffer(m["body"], "<u2")
    own = bits[x.inverse] if len(x.inverse) else bits
    # of equal occurrences of the chunk the first has the smallest id: in a later document all that fits is removed
    again = ids[x.doc] > ids[x.doc[x.first]][x.inverse] if len(x.inverse) else np.zeros(0, bool)
    begins = []
    for k in range(REACH + 1):
        on = ((own >> np.uint16(k)) & np.uint16(1)).astype(bool) | (again & (x.left >= k) & (x.right >= REACH - k))
        begins.append(x.at[on] - k)
    begin, size = np.concatenate(begins), len(x.sample.bytes) + length
    edges = np.bincount(begin, minlength=size) - np.bincount(begin + length, minlength=size)
    return np.cumsum(edges) > 0


RESULT = "f binary, least long, n_bytes long, n_removed long, n_spans long, kept binary"


def kept_bytes(table: DataFrame, replies: DataFrame, marks: DataFrame, length: int, buckets: int, digest: bool) -> DataFrame:
    """(f, least: smallest id, n_bytes, n_removed, n_spans, kept: bytes left, or their sha256) of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, prints, sizes, body, told, marked_ in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                gone = None
                if marked_:
                    gone = spans(Suffixes(sizes, body, told or [], length, buckets), np.array(ids, np.int64), marked_, length)
                out, end = [], 0
                for d, f, n in zip(ids, prints, sizes, strict=True):
                    begin, end = end, end + n
                    flags = gone[begin:end] if gone is not None else np.zeros(0, bool)
                    text, removed, runs = body[begin:end], int(flags.sum()), 0
                    if removed:
                        runs = int((flags[1:] & ~flags[:-1]).sum()) + int(flags[0])
                        text = np.frombuffer(text, np.uint8)[~flags].tobytes()
                    out.append((f, d, n, removed, runs, hashlib.sha256(text).digest() if digest else text))
                columns = zip(*out, strict=True)
                kinds = [pa.binary()] + [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["f", "least", "n_bytes", "n_removed", "n_spans", "kept"])

    gather = lambda rows, name: rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias(name))
    joined = table.join(gather(replies, "told"), "chunk", "left").join(gather(marks, "marks"), "chunk", "left")
    return joined.select("ids", "prints", "sizes", "body", "told", "marks").mapInArrow(run, RESULT)


def dedup_substrings(docs: DataFrame, length: int = 50, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is what is left of the text, in bytes, or its sha256.

    ``length`` is at least 20: ranks need eight bytes.
    """
    if length < REACH + 8:
        raise ValueError("length must be at least 20")
    spark = docs.sparkSession
    folder, buckets = shared_dir(spark), partitions(spark) * SPLIT
    table = settled(chunks(first_texts(docs)), f"{folder}/chunks")
    replies = settled(repeated_ranks(table, length, buckets), f"{folder}/ranks")
    marks = settled(later_strings(table, replies, length, buckets), f"{folder}/marks")
    found = settled(kept_bytes(table, replies, marks, length, buckets, digest), f"{folder}/found")
    # later copies of a text are covered whole, if they are long enough
    rows = docs.select("doc_id", _id().alias("_id"), _print().alias("f")).join(found, "f")
    gone = (F.col("_id") > F.col("least")) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").digest() if digest else b""
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(gone, F.lit(nothing)).otherwise(F.col("kept")).alias("kept"),
    )
