"""Members of one huge JSON array or object, read by many tasks.

Spark's text reader cuts the file into splits and each split into rows at commas, wherever
these stand: in strings, nested values, or between members. What a comma means depends on
whether a string is open and how deep brackets are nested, which a split cannot see. So each
split is first read under both states of the string, and reduces to how the state, the depth
and the number of commas at each relative depth change. These few numbers a split are put
together in order, which gives the state at the beginning of every split, and with it the
place of its first member. A second pass cuts the members; those that go over a border are put
together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA = b'"\\,'
_STEP = np.zeros(256, np.int64)
_STEP[[*b"[{"]], _STEP[[*b"]}"]] = 1, -1


@dataclass
class State:
    """Where a reader is: whether a string is open, how deep it is, and commas passed by depth."""

    string: bool = False
    depth: int = 0
    commas: dict[int, int] = field(default_factory=dict)


def structure(data: np.ndarray, string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Depth after each byte, relative to the first one's, which bytes are outside strings, and whether a string is open at the end."""
    plain = np.maximum.accumulate(np.where(data == BACKSLASH, -1, np.arange(len(data))))
    quotes = np.flatnonzero(data == QUOTE)
    before = np.where(quotes > 0, plain[quotes - 1], -1)
    real = quotes[(quotes - 1 - before) % 2 == 0]  # an even number of backslashes ahead
    marks = np.zeros(len(data), np.int64)
    marks[real] = 1
    inside = (np.cumsum(marks) + string) % 2 == 1
    outside = ~inside
    outside[real] = False
    return np.cumsum(np.where(outside, _STEP[data], 0)), outside, bool((len(real) + string) % 2)


def advance(state: State, data: np.ndarray) -> None:
    if not len(data):
        return
    depth, outside, state.string = structure(data, state.string)
    at, n = np.unique(depth[outside & (data == COMMA)], return_counts=True)
    for d, k in zip((at + state.depth).tolist(), n.tolist(), strict=True):
        state.commas[d] = state.commas.get(d, 0) + k
    state.depth += int(depth[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(start of the split, its rows with their commas) of the rows of a batch, split by split."""
    starts = batch.column(0).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)]
    texts = batch.column(1).cast(pa.binary())
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(starts[a]), b",".join(texts.slice(a, b - a).to_pylist()) + b","


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, tuple[State, State]] = {}  # those of the task's splits
    for batch in batches:
        for start, body in _runs(batch):
            data = np.frombuffer(body, np.uint8)
            for s in states.setdefault(start, (State(False), State(True))):
                advance(s, data)
    rows = [(start, k, s.string, s.depth, list(s.commas), list(s.commas.values())) for start, both in states.items() for k, s in enumerate(both)]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["start", "entered", "string", "depth", "depths", "commas"]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def entered(rows: list) -> dict[int, tuple[bool, int, int]]:
    """(string, depth, members ended) at the start of each split, from the summaries of all; an error where the file is no JSON value."""
    by_start: dict[int, dict[int, object]] = {}
    for r in rows:
        by_start.setdefault(r["start"], {})[r["entered"]] = r
    out, string, depth, ended = {}, False, 0, 0
    for start in sorted(by_start):
        out[start] = (string, depth, ended)
        r = by_start[start][int(string)]
        ended += dict(zip(r["depths"], r["commas"], strict=True)).get(1 - depth, 0)
        string, depth = r["string"], depth + r["depth"]
    if string or depth or not out:
        raise ValueError("the JSON text ends too early" if out else "the JSON file is empty")
    return out


class Cutter:
    """Members of a split, as (place, text, whole); a part goes over the split's border."""

    def __init__(self, string: bool, depth: int, ended: int):
        self.string, self.depth, self.place = string, depth, ended
        # inside a member at the border: what comes first is a part
        self.held, self.whole = [], depth < 1

    def feed(self, body: bytes) -> Iterator[tuple[int, bytes, bool]]:
        data = np.frombuffer(body, np.uint8)
        depth, outside, string = structure(data, self.string)
        depth = depth + self.depth
        step = np.where(outside, _STEP[data], 0)
        ends = np.flatnonzero((outside & (data == COMMA) & (depth == 1)) | ((step < 0) & (depth == 0)))
        begins = np.flatnonzero((step > 0) & (depth == 1))
        events = sorted([*((int(k), True) for k in ends), *((int(k), False) for k in begins)])
        at, inside = 0, self.depth >= 1
        for k, end in events:
            if end:
                self.held.append(body[at:k])
                yield self.place, b"".join(self.held), self.whole
                self.held, self.whole = [], True
                self.place += int(data[k] == COMMA)
                inside = data[k] == COMMA
            else:
                self.held, self.whole, inside = [], True, True
            at = k + 1
        if inside:
            self.held.append(body[at:])
        self.string, self.depth = string, int(depth[-1])

    def rest(self) -> Iterator[tuple[int, bytes, bool]]:
        if self.depth >= 1:
            yield self.place, b"".join(self.held), False


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(place, member: its JSON text) of the members of the array or object in the file ``path``; blank ones are left out."""
    rows = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_block_start").alias("start"), "value")
    found = rows.mapInArrow(_summaries, "start long, entered int, string boolean, depth long, depths array<bigint>, commas array<bigint>")
    places = entered(found.collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters: dict[int, Cutter] = {}

        def out(start: int, members: list) -> pa.RecordBatch:
            columns = zip(*members, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([start] * len(members), pa.int64())], names=["place", "member", "whole", "start"])

        for batch in batches:
            for start, body in _runs(batch):
                members = list(cutters.setdefault(start, Cutter(*places[start])).feed(body))
                if members:
                    yield out(start, members)
        for start, cutter in cutters.items():
            members = list(cutter.rest())
            if members:
                yield out(start, members)

    pieces = rows.mapInArrow(cut, "place long, member binary, whole boolean, start long").withColumn("member", F.col("member").cast("string"))
    parts = pieces.filter(~F.col("whole")).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "member"))).alias("p"))
    members = pieces.filter("whole").select("place", "member").unionAll(parts.select("place", F.array_join("p.member", "")))
    return members.filter(F.regexp_like("member", F.lit(r"[^\x20\x09\x0A\x0D]")))
