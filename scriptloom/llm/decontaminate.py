"""Benchmark decontamination by q-gram lemma filtering.

A stretch of ``window`` bytes with at most ``k`` edits shares at least
window + 1 - q * (k + 1) of its q-grams with the original, all within k of one
diagonal. Shared q-grams of a document and the benchmark are gathered by item
and by overlapping diagonal bands, counted over stretches of the window's
length, and only regions that meet the bound go on to a banded alignment.

Texts are compared as UTF-8 bytes, in lower case and with ASCII white space as
spaces. Items shorter than the window are wanted whole; items shorter than
``LEAST`` bytes too, exactly as they are and between word borders (one automaton
finds all of them in one pass), as they are too short for the bound to tell.

The benchmark goes to the workers in blocks of at most ``BLOCK_BYTES`` of text,
one pass over the documents for each block.

Defined results: null and empty texts and items match nothing; repeated rows are
judged one by one; extra columns are carried where documents are filtered; an
empty table on either side finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, seeds64, slices

Q, WINDOW, RATE, LEAST, BAND = 12, 80, 0.05, 32, 16
BLOCK_BYTES = 16 << 20
_TABLE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_FILTER_BITS = 22
#: Pairs of equal q-grams that are held at once; texts with more of them are searched in overlapping stretches.
PAIRS = 1 << 20
#: Bytes of a text between the first and the last shared q-gram of a region: a window and the width of a band.
REACH = WINDOW + BAND


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q bytes that begin at each position."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    n = len(data) - q + 1
    wide = data.astype(np.uint64)
    words, at = np.zeros(n, np.uint64), 0
    pair = wide[:-1] | (wide[1:] << np.uint64(8))
    four = pair[:-2] | (pair[2:] << np.uint64(16)) if q >= 4 else None
    m = seeds64(8, 3)
    k = 0
    while at < q:
        step = 4 if q - at >= 4 else 1
        part = four[at : at + n] if step == 4 else wide[at : at + n]
        words = (words ^ part) * m[k % 8]
        words ^= words >> np.uint64(29)
        at, k = at + step, k + 1
    return words


#: Bytes of words: letters, digits and all of characters beyond ASCII.
_WORD = [bytes([c]).isalnum() or c >= 128 for c in range(256)]


def _automaton(items: list[tuple[int, bytes]]):
    """Finds all the given strings at once; None without any."""
    import ahocorasick

    if not items:
        return None
    by_text: dict[bytes, list[int]] = {}
    for i, b in items:
        by_text.setdefault(b, []).append(i)
    out = ahocorasick.Automaton()
    for b, ids in by_text.items():
        out.add_word(b.decode("latin-1"), (ids, len(b)))
    out.make_automaton()
    return out


class Block:
    """q-gram index of some benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        short = [(i, b.strip(b" ")) for i, b in items if len(b) < LEAST]
        self.short = _automaton([(i, b) for i, b in short if b])
        items = [(i, b) for i, b in items if len(b) >= LEAST]
        self.ids = [i for i, _ in items]
        self.texts = [b for _, b in items]
        grams = [qgrams(np.frombuffer(b, np.uint8)) for b in self.texts]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item, self.at = item[order], at[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.hashes)] = True

    def short_matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, begin, end, 0) of the first place of each short item, in bytes."""
        out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for t, data in enumerate(texts) if self.short is not None else ():
            for last, (ids, n) in self.short.iter(data.decode("latin-1")):
                begin, end = last + 1 - n, last + 1
                if not (_WORD[data[begin]] and begin and _WORD[data[begin - 1]]) and not (_WORD[data[last]] and end < len(data) and _WORD[data[end]]):
                    for i in ids:
                        out.setdefault((t, i), (t, i, begin, end, 0))
        return list(out.values())

    def found(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, begin, end, edits) of all items."""
        return [(t, self.ids[i], x, y, e) for t, i, x, y, e in self.search(texts)] + self.short_matches(texts)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def window(self, item: int) -> tuple[int, int, int]:
        """(length, edits, shared q-grams needed) for a stretch of an item."""
        w = min(WINDOW, len(self.texts[item]))
        k = int(w * RATE)
        return w, k, max(1, w + 1 - Q * (k + 1))

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, begin, end, edits) of verified regions, in bytes."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0, *map(len, texts)])
        h = qgrams(data)
        where = np.flatnonzero(self.filter[self._slot(h)])
        if not len(where) or not len(self.hashes):
            return []
        found = np.minimum(np.searchsorted(self.hashes, h[where]), len(self.hashes) - 1)
        same = self.hashes[found] == h[where]
        where, found = where[same], found[same]
        text = np.searchsorted(starts, where, side="right") - 1
        inside = where + Q <= starts[text + 1]
        where, found, text = where[inside], found[inside], text[inside]
        # some runs (of blanks, say) occur at many places of the benchmark: bound the pairs by stretches of the shared
        # q-grams; a region spans at most REACH bytes of a text, so it lies whole in one of two that overlap by that
        before = np.append(0, np.cumsum(self.first[found + 1] - self.first[found]))
        done: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        begin = 0
        while begin < len(where):
            end = max(begin + 1, int(np.searchsorted(before, before[begin] + PAIRS, side="right")) - 1)
            if end < len(where):
                end = max(end, int(np.searchsorted(where, where[begin] + 2 * REACH)))
            part = slice(begin, end)
            regions = self._regions(*self._pairs(where[part], found[part], text[part], starts))
            for row in self._verify(texts, [r for r in regions if r[:2] not in done]):
                done.setdefault(row[:2], row)
            if end >= len(where):
                break
            begin = max(begin + 1, int(np.searchsorted(where, where[end] - REACH)))
        return list(done.values())

    def _pairs(self, where, found, text, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place in the text, place in the item) of each pair of equal q-grams."""
        many = self.first[found + 1] - self.first[found]
        entry = np.repeat(self.first[found] - np.cumsum(many) + many, many) + np.arange(many.sum())
        text = np.repeat(text, many)
        return text, self.item[entry], np.repeat(where, many) - starts[text], self.at[entry]

    def _regions(self, text, item, pos, at) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
        """Candidate (text, item, diagonal, [(first, last) of the shared q-grams that meet the bound]) by band."""
        if not len(text):
            return []
        diagonal = pos - at
        out = []
        for shift in (0, BAND // 2):  # each pair of near diagonals is in one band of at least one of the two grids
            band = (diagonal + shift) // BAND
            order = np.lexsort((at, band, item, text))
            t, i, b, a, d = text[order], item[order], band[order], at[order], diagonal[order]
            # each q-gram of the item counts once a band, at however many places of the text it stands
            other = (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0)
            once = np.concatenate([[True], other | (np.diff(a) != 0)])
            t, i, b, a, d = t[once], i[once], b[once], a[once], d[once]
            group = np.cumsum(np.concatenate([[0], (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0)]))
            lengths = np.array([len(x) for x in self.texts])[i]
            w = np.minimum(WINDOW, lengths)
            need = np.maximum(1, w + 1 - Q * ((w * RATE).astype(np.int64) + 1))
            last = np.arange(len(t)) + need - 1
            ok = last < len(t)
            last = np.minimum(last, len(t) - 1)
            ok &= (group[last] == group) & (a[last] - a <= w - Q)
            hit = np.flatnonzero(ok)
            if len(hit):
                keep = np.concatenate([[True], group[hit][1:] != group[hit][:-1]])
                firsts = hit[keep]
                ends = np.append(firsts[1:], len(t))
                for f, e in zip(firsts.tolist(), ends.tolist(), strict=True):
                    same = slice(f, f + int(np.searchsorted(group[f:e], group[f], side="right")))
                    hits = hit[np.searchsorted(hit, f) : np.searchsorted(hit, same.stop)]
                    out.append((int(t[f]), int(i[f]), int(np.median(d[same])), list(zip(a[hits].tolist(), a[last[hits]].tolist(), strict=True))))
        return out

    def _verify(self, texts: list[bytes], regions: list) -> list[tuple[int, int, int, int, int]]:
        out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for t, i, diagonal, spans in regions:
            if (t, i) in out:
                continue
            w, k, _ = self.window(i)
            item = self.texts[i]
            # a window that holds the q-grams from first to last begins in this range
            begins = sorted({b for first, last in spans for b in range(max(0, last + Q - w), min(first, len(item) - w) + 1)})
            pieces = [(b, low := max(0, b + diagonal - BAND - k), texts[t][low : b + diagonal + w + BAND + k]) for b in begins]
            for equal in (True, False):  # equal stretches first
                for b, low, piece in pieces:
                    pattern = item[b : b + w]
                    if equal and pattern not in piece:
                        continue
                    edits, x, y = align(pattern, piece)
                    if edits <= k:
                        out[t, i] = (t, i, low + x, low + y, edits)
                        break
                if (t, i) in out:
                    break
        return list(out.values())


def align(pattern: bytes, text: bytes) -> tuple[int, int, int]:
    """(edits, begin, end) of the stretch of ``text`` nearest to ``pattern``: dynamic programming over a band of the text."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    p, s = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8)
    steps = np.arange(len(s) + 1)
    row, begin = np.zeros(len(s) + 1, np.int64), steps.copy()
    for k in range(len(p)):
        base = np.empty(len(s) + 1, np.int64)
        origin = np.empty(len(s) + 1, np.int64)
        base[0], origin[0] = row[0] + 1, begin[0]
        across, down = row[:-1] + (s != p[k]), row[1:] + 1
        base[1:] = np.minimum(across, down)
        origin[1:] = np.where(across <= down, begin[:-1], begin[1:])
        # insertions: running minimum of base - position
        lowered = (base - steps) * (len(s) + 2) + steps[::-1]
        best = np.minimum.accumulate(lowered)
        source = len(s) - (best % (len(s) + 2))
        row = base[source] + steps - source
        begin = origin[source]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of bounded size."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if r["text"] is None or r["item_id"] is None:
            continue
        data = normal(r["text"])
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], data))
        size += len(data)
    if block:
        yield block


_BUILT: dict[str, Block] = {}


def _built(key: str, shipped) -> Block:
    """The index of this worker, rebuilt when another block arrives."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Block(shipped.value)
    return _BUILT[key]


def _texts(column: pa.Array) -> list[bytes]:
    return [normal(x) for x in column.to_pylist()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, edits) of each document and item it holds a stretch of; byte positions of the first one."""
    context = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, begin long, end long, edits int"

    def finder(shipped):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _built(name, shipped)
            for batch in (p for b in batches for p in slices(b, 2 << 20)):
                rows = block.found(_texts(batch.column(1)))
                if rows:
                    ids = batch.column(0).to_pylist()
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": ids[t], "item_id": i, "begin": x, "end": y, "edits": e} for t, i, x, y, e in rows],
                        schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]),
                    )

        return run

    parts = [docs.select("doc_id", "text").mapInArrow(finder(context.broadcast(block)), schema) for block in _blocks(benchmark)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no stretch of the benchmark, with their own columns."""
    context = docs.sparkSession.sparkContext
    text = docs.columns.index("text")

    def keeper(shipped):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _built(name, shipped)
            for batch in (p for b in batches for p in slices(b, 2 << 20)):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in block.found(_texts(batch.column(text)))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(keeper(context.broadcast(block)), docs.schema)
    return docs
