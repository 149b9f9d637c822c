"""Phrase mining by prefix projection: contiguous patterns grow to the right, depth first, prefix by prefix.

1. Documents become chunks: the words of a chunk by their place in its own vocabulary, with
   gaps between pieces. Chunks are written once below the shared folder.
2. Prefixes. Each chunk counts its pairs of neighbouring words; counts meet by hash (64 bits
   beside those of the bucket), and every pair with enough occurrences gets an id, which its
   chunks are told. What follows works on ids: a phrase of k words is k - 1 ids in a row.
3. Projection. For each frequent prefix, the chunk sends where it occurs: what comes after it,
   up to the longest phrase and no further than a pair that is not frequent, equal ones added up.
   Occurrences are dealt by (prefix, next pair), so that a prefix that fills the corpus is many
   tasks; what one chunk sends is never more than its distinct continuations.
4. Growth. A task sorts the occurrences of its prefixes and descends: those that go on with one
   more id often enough are a phrase, and are searched in turn, until the phrase is too long.
5. Scores, containment and the best of each language are joins and aggregations of phrases.

Words are cut at spaces and tabs, pieces at ``[.,;:!?\\x0A-\\x0D]``, after lowering A-Z. A null
text is empty, a null language is ``und``, doc_id plays no part; repeated rows count again.
Extra columns are ignored; an empty table gives no rows. Ties are ordered by the phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, partitions, shared_dir, slices

#: Bytes of text in a chunk (a longer text is one chunk), and buckets of a shuffle partition: of pairs, and of occurrences.
CHUNK_BYTES, SPLIT, DEALT = 4 << 20, 2, 6
#: Bytes of a batch that goes to Python (one row at least), and of occurrences that wait before equal ones are added up.
BATCH_BYTES, HELD_BYTES = 8 << 20, 24 << 20
#: Chunks are few and large: Parquet looks at the size after each row, so that writers and readers hold a few of them.
FEW_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(rb"[.,;:!?\x0a-\x0d]+|[^.,;:!?\x0a-\x0d \t]+")
_BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")
CHUNKS = "chunk long, langs array<string>, words array<binary>, word_lang array<int>, codes binary"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside send their rows to Python by ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as Python values, one at a time."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of some documents each: their words (with the language's place in langs), and the texts as places in words; -1 is a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids are those of one written table: a task that runs again replaces its rows whole
        first, made = TaskContext.get().partitionId() << 32, 0
        langs: dict[str, int] = {}
        vocabulary: list[dict[bytes, int]] = []
        n, size, codes = 0, 0, []

        def flush() -> pa.RecordBatch:
            words, place = [b""] * n, np.zeros(n, np.int32)
            for k, known in enumerate(vocabulary):
                for w, c in known.items():
                    words[c], place[c] = w, k
            arrays = [pa.array([first + made], pa.int64()), pa.array([list(langs)], pa.list_(pa.string())), pa.array([words], pa.list_(pa.binary())), pa.array([place], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([np.array(codes, "<i4").tobytes()])], names=["chunk", "langs", "words", "word_lang", "codes"])

        for batch in batches:
            for piece in slices(batch):
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if not text:
                        continue
                    if size and size + len(text) > CHUNK_BYTES:
                        yield flush()
                        made += 1
                        langs, vocabulary, n, size, codes = {}, [], 0, 0, []
                    if lang not in langs:
                        langs[lang] = len(langs)
                        vocabulary.append({})
                    known = vocabulary[langs[lang]]
                    for token in _TOKEN.findall(text.translate(_LOWER)):
                        if token[0] in _BREAKS:
                            codes.append(-1)
                        else:
                            c = known.get(token)
                            if c is None:
                                c = known[token] = n
                                n += 1
                            codes.append(c)
                    codes.append(-1)
                    size += len(text)
        if size:
            yield flush()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, CHUNKS)


def word_counts(table: DataFrame) -> DataFrame:
    """(lang, phrase, f) of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, words, place, codes in _rows(batch):
                codes = np.frombuffer(codes, "<i4")
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([langs[p] for p in place], pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

    rows = table.select("langs", "words", "word_lang", "codes").mapInArrow(run, "lang string, word binary, n long")
    return rows.groupBy("lang", F.col("word").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))


class Pairs:
    """The distinct pairs of neighbouring words of a chunk, in an order that depends on the chunk alone."""

    def __init__(self, langs: list[str], words: list[bytes], place: list[int], codes: bytes, buckets: int):
        c = np.frombuffer(codes, "<i4")
        a, b = c[:-1], c[1:]
        self.where = np.flatnonzero((a >= 0) & (b >= 0)).astype(np.int32)
        self.n = len(c)
        both, inverse, self.counts = np.unique(a[self.where].astype(np.int64) * max(len(words), 1) + b[self.where], return_inverse=True, return_counts=True)
        self.inverse = inverse.astype(np.int32)
        self.left, self.right = np.divmod(both, max(len(words), 1))
        marks = [x.encode() + b"\0" for x in langs]
        h = np.array([xxhash.xxh64_intdigest(marks[p] + w) for w, p in zip(words, place, strict=True)], np.uint64)
        self.hash = mix64(h[self.left] + np.uint64(0x9E3779B97F4A7C15) * mix64(h[self.right])) if len(both) else h[:0]
        second = mix64(h[self.right] * np.uint64(0xD6E8FEB86659FD93) + mix64(h[self.left] ^ np.uint64(0xC0FFEE))) if len(both) else h[:0]
        bucket = (second % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def of(self, bucket: int) -> np.ndarray:
        return self.order[self.cuts[bucket] : self.cuts[bucket + 1]]


def _dealt(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows by bucket, one bucket after another in a partition."""
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", *names)


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


def frequent_pairs(table: DataFrame, least: int, buckets: int) -> DataFrame:
    """(chunk, bucket, at: places among the chunk's pairs of the bucket, ids, told, totals): pairs with ``least`` occurrences.

    A pair's id is above 0 and its own; the first chunk that holds it is told to spell it out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *rest in _rows(batch):
                pairs = Pairs(*rest, buckets)
                some = [b for b in range(buckets) if pairs.cuts[b] < pairs.cuts[b + 1]]
                bodies = [(pairs.hash[o].astype("<u8").tobytes(), pairs.counts[o].astype("<u4").tobytes()) for o in map(pairs.of, some)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), *[pa.array([x[k] for x in bodies], pa.binary()) for k in (0, 1)]], names=["bucket", "chunk", "hashes", "counts"]
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            hashes = np.concatenate([np.frombuffer(r[1], "<u8") for r in rows])
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            totals = np.zeros(len(first), np.int64)
            np.add.at(totals, inverse, np.concatenate([np.frombuffer(r[2], "<u4") for r in rows]).astype(np.int64))
            ids = np.where(totals >= least, np.cumsum(totals >= least), 0)
            told = np.zeros(len(hashes), bool)
            told[first] = True
            begin = 0
            for chunk, body, _ in rows:
                mine = slice(begin, begin + len(body) // 8)
                begin = mine.stop
                at = np.flatnonzero(ids[inverse[mine]])
                if len(at):
                    which = inverse[mine][at]
                    packed = [at.astype("<i4"), (ids[which] + (bucket << 32)).astype("<i8"), told[mine][at].astype("u1"), totals[which].astype("<i8")]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()]) for x in packed]], names=["chunk", "bucket", "at", "ids", "told", "totals"])

    return _dealt(table.mapInArrow(count, "bucket int, chunk long, hashes binary, counts binary"), ("chunk",)).mapInArrow(meet, "chunk long, bucket int, at binary, ids binary, told binary, totals binary")


PROJECTED = "bucket int, chunk long, body binary, id long, lang string, first binary, second binary, f long"


def projections(table: DataFrame, replies: DataFrame, longest: int, buckets: int, dealt: int) -> DataFrame:
    """Occurrences of frequent prefixes in chunks (bucket, one of ``dealt``, chunk, body: columns of ids, then counts), and the spelling of ids (bucket -1).

    ``buckets`` are those of the pairs, as in the replies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, langs, words, place, codes, told in _rows(batch):
                pairs = Pairs(langs, words, place, codes, buckets)
                ids = np.zeros(len(pairs.counts), np.int64)
                spelled = []
                for reply in told:
                    at = pairs.of(reply["bucket"])[np.frombuffer(reply["at"], "<i4")]
                    ids[at] = np.frombuffer(reply["ids"], "<i8")
                    mine = np.frombuffer(reply["told"], "u1") > 0
                    spelled += zip(at[mine].tolist(), np.frombuffer(reply["totals"], "<i8")[mine].tolist(), strict=True)
                k = len(spelled)
                left, right = ([words[int(side[p])] for p, _ in spelled] for side in (pairs.left, pairs.right))
                arrays = [pa.array([-1] * k, pa.int32()), pa.array([chunk] * k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(ids[[p for p, _ in spelled]] if k else [], pa.int64())]
                arrays += [pa.array([langs[place[int(pairs.left[p])]] for p, _ in spelled], pa.string()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array([f for _, f in spelled], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "chunk", "body", "id", "lang", "first", "second", "f"])
                # the chunk as ids of pairs; 0 where a pair is rare or a gap
                depth = longest - 1
                line = np.zeros(pairs.n + depth, np.int64)
                line[pairs.where] = ids[pairs.inverse]
                where = np.flatnonzero((line[: pairs.n] > 0) & (line[1 : pairs.n + 1] > 0)).astype(np.int32)
                del pairs, ids, told, words, codes
                if depth < 2 or not len(where):
                    continue
                columns = [line[where], line[where + 1]]
                for d in range(2, depth):
                    columns.append(np.where(columns[-1] > 0, line[where + d], 0))
                del line, where
                columns = added_up(columns, None)
                counts = columns.pop()
                deal = (mix64(columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + columns[1].astype(np.uint64)) % np.uint64(dealt)).astype(np.int64)
                by = np.argsort(deal, kind="stable")
                cuts = np.searchsorted(deal[by], np.arange(dealt + 1))
                some = [b for b in range(dealt) if cuts[b] < cuts[b + 1]]
                bodies = [b"".join(c[by[cuts[b] : cuts[b + 1]]].astype("<i8").tobytes() for c in (*columns, counts)) for b in some]
                k = len(some)
                arrays = [pa.array(some, pa.int32()), pa.array([chunk] * k, pa.int64()), pa.array(bodies, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "chunk", "body", "id", "lang", "first", "second", "f"])

    told = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "at", "ids", "told", "totals")).alias("told"))
    return table.join(told, "chunk").select("chunk", "langs", "words", "word_lang", "codes", "told").mapInArrow(run, PROJECTED)


def added_up(columns: list[np.ndarray], counts: np.ndarray | None) -> list[np.ndarray]:
    """Sorted distinct rows of ``columns``, and their summed counts (1 each if None) as the last column."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k, column in enumerate(columns):
        columns[k] = column = column[order]
        new[1:] |= column[1:] != column[:-1]
    begin = np.flatnonzero(new)
    total = np.diff(np.append(begin, len(order))) if counts is None else np.add.reduceat(counts[order], begin) if len(order) else counts
    return [*(c[begin] for c in columns), total.astype(np.int64)]


def descend(columns: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(ids, occurrences) of all patterns of two ids and more with ``least`` occurrences, depth first; rows are sorted, 0 ends a row."""
    total = np.concatenate([[0], np.cumsum(counts)])

    def grow(lo: int, hi: int, depth: int, prefix: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
        column = columns[depth][lo:hi]
        begin = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        end = np.append(begin[1:], len(column))
        f = total[lo + end] - total[lo + begin]
        for k in np.flatnonzero((f >= least) & (column[begin] > 0)).tolist():
            longer = (*prefix, int(column[begin[k]]))
            if depth:
                yield longer, int(f[k])
            if depth + 1 < len(columns):
                yield from grow(lo + int(begin[k]), lo + int(end[k]), depth + 1, longer)

    if len(counts):
        yield from grow(0, len(counts), 0, ())


def grown(projected: DataFrame, longest: int, least: int) -> DataFrame:
    """(ids, f) of the phrases of three words and more."""
    depth = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None

        def merged() -> list[np.ndarray]:
            parts = [np.frombuffer(x, "<i8").reshape(depth + 1, -1) if isinstance(x, bytes) else x for x in held]
            columns = [np.concatenate([p[d] for p in parts]) for d in range(depth + 1)]
            counts = columns.pop()
            return added_up(columns, counts)

        def phrases() -> pa.RecordBatch:
            *columns, counts = merged()
            found = list(descend(columns, counts, least))
            return pa.RecordBatch.from_arrays([pa.array([list(p) for p, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.int64())], names=["ids", "f"])

        for batch in batches:
            for bucket, body in _rows(batch):
                if bucket != at:
                    if held:
                        yield phrases()
                    held, size, at, limit = [], 0, bucket, HELD_BYTES
                held.append(body)
                size += len(body)
                if size > limit:  # rows that differ stay; the next merge waits for as many again
                    held = [merged()]
                    size = sum(c.nbytes for c in held[0])
                    limit = max(HELD_BYTES, 2 * size)
        if held:
            yield phrases()

    rows = _dealt(projected.filter("bucket >= 0").select("bucket", "chunk", "body"), ("chunk",)).select("bucket", "body")
    return rows.mapInArrow(run, "ids array<bigint>, f long")


def candidates(docs: DataFrame, longest: int, least: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, size) of frequent phrases of two words and more, and (lang, phrase, f) of all single words."""
    spark = docs.sparkSession
    with small_batches(spark):
        return _candidates(docs, longest, least, folder, partitions(spark) * SPLIT, partitions(spark) * DEALT)


def _candidates(docs: DataFrame, longest: int, least: int, folder: str, buckets: int, dealt: int) -> tuple[DataFrame, DataFrame]:
    table = materialise(chunks(docs), f"{folder}/chunks", FEW_ROWS)
    words = materialise(word_counts(table), f"{folder}/words")
    replies = materialise(frequent_pairs(table, least, buckets), f"{folder}/pairs")
    projected = materialise(projections(table, replies, longest, buckets, dealt), f"{folder}/projected")
    spelled = projected.filter("bucket < 0").select("id", "lang", F.col("first").cast("string").alias("first"), F.col("second").cast("string").alias("second"), "f")
    two = spelled.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "f", F.lit(2).alias("size"))
    if longest == 2:
        return materialise(two, f"{folder}/candidates"), words
    more = grown(projected, longest, least).select("ids", "f", F.posexplode("ids").alias("p", "id"))
    parts = more.join(spelled.drop("f"), "id").groupBy("ids", "f").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("p", "first", "second"))).alias("x"))
    phrase = F.concat_ws(" ", F.get("x", F.lit(0))["first"], F.col("x.second"))
    return materialise(two.unionAll(parts.select("lang", phrase, "f", (F.size("ids") + 1))), f"{folder}/candidates"), words


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest-scoring cut."""
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = found.select("lang", "phrase", "f").unionAll(words)
    w = F.split("phrase", " ", -1)
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # products of up to 36 digits, in decimals
    score = F.expr("CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0)) div (CAST(l AS DECIMAL(16, 0)) * CAST(r AS DECIMAL(16, 0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def maximal(found: DataFrame, percent: int) -> DataFrame:
    """``found`` without the phrases inside a longer one with 100 * f(longer) >= ``percent`` * f."""
    w = F.split("phrase", " ", -1)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda b: F.array_join(F.slice("w", b, n), " "))))
    inner = found.filter("size > 2").withColumn("w", w).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("f").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left")
    return kept.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * percent)).select(*found.columns)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    found, words = candidates(docs, longest, least, shared_dir(docs.sparkSession))
    kept = maximal(found, percent).select("lang", "phrase")
    rows = scored(found, words).join(kept, ["lang", "phrase"], "left_semi")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that no task sorts a whole language
    share = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))).alias("share")
    some = rows.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "share")
    placed = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return placed.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
