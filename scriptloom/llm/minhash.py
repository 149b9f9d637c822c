"""Near-duplicate detection: MinHash with tensored banding, links confirmed on full sets.

Signatures. A document's set is its distinct word shingles (64-bit hashes). Of
``SKETCHES`` small collections of two minhashes each, every pair forms a table key:
26 minhashes serve 78 tables. Two sets of similarity 0.8 share no key with
probability 4.1e-5, of 0.9 with 2.4e-8; nothing else below loses more than 3e-8.

Representatives. Documents with equal sets (128-bit fingerprint) are one.

Hubs. A member's weight is the number of members of all its keys; each key's heaviest
member is its hub, with which the others pair (no pairs within a key): of edited
copies that is the least edited one. Pairs that agree in ``AGREE`` of 26 minhashes are
confirmed one by one on their full sets: 100 * intersection >= 80 * union. True links
alone make components.

What is left are keys whose members are in several components. There members outside
the largest component meet a random member of it, and the heaviest one outside.
Of the members of keys that still hold several components, those are put together to groups that
share one of their rarest shingles (as many of these as two linked sets must have in common: an exact
filter, by which members that share only a crowd's template do not meet), directly or through
components, and each group's members outside its largest component are compared with
all others, exactly and on whole sets, unless they are joined already. Members are
dealt to blocks by set size (linked sets are in the same or the next class), and two
blocks are one task, so its work is bounded: ``BLOCK`` members a block, up to ``MOST``
where a group would have more than ``BLOCKS`` of them, and ``BLOCK_SHINGLES`` shingles. So
every linked pair that shares a key is in one component at the end. Members
of a group of m different texts that do not link are sent m / block times; with rare shingles
of their own they are in no group.

Words are ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z. Fewer words than the shingle
size: the whole sequence is the one shingle. Null or wordless texts have the empty
set and link with nothing. Repeated rows and null ids are kept: null ids take part
under no id (component null, kept); different texts under one id link what any of
them links. Extra columns are ignored or carried, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, mix64, partitions, remove, seeds64, shared_dir
from .components import components

SKETCHES, EACH, AGREE = 13, 2, 9
PAIRS = [(i, j) for i in range(SKETCHES) for j in range(i + 1, SKETCHES)]
#: Members of a block, and the most where a group has more than ``BLOCKS`` such blocks; shingles of a block.
BLOCK, MOST, BLOCKS, BLOCK_SHINGLES = 256, 2048, 64, 400_000
PERCENT = 80
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of each word of a lowered byte text."""
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACES[b]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    # a sum over the word of a random value for (byte, place in the word), then mixed with the length
    place = np.arange(len(b))
    place[begin[0] :] -= np.repeat(begin, np.diff(np.append(begin, len(b))))
    value = (_BYTE[b] ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value[~word] = 0
    total = np.add.reduceat(value, begin)
    return mix64(total + (end - begin).astype(np.uint64)), begin


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    joined = b"\n".join(t.translate(_LOWER) for t in texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    h, begin = word_hashes(joined)
    cuts = np.searchsorted(begin, starts)
    m = seeds64(size, 5)
    out = []
    n = len(h) - size + 1
    rolled = mix64(sum((h[k : k + n] * m[k] for k in range(1, size)), h[:n] * m[0])) if n > 0 else h[:0]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = sum((h[a + k : a + k + 1] * m[k] for k in range(b - a)), np.array([b - a], np.uint64))
            out.append(mix64(short))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 minhashes, one row for each (non-empty) set."""
    n = SKETCHES * EACH
    a, c = seeds64(n, 23), mix64(seeds64(n, 29))
    joined = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        x = joined * a[k] + c[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
    return out


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2: fingerprint of the set, sig: minhashes) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(_bytes(batch.column(1)), size)
        some = [k for k, s in enumerate(sets) if len(s)]
        sig: list = [None] * len(sets)
        f = np.zeros((2, len(sets)), np.uint64)
        if some:
            rows = signatures([sets[k] for k in some]).view(np.int32)
            for k, r in zip(some, rows, strict=True):
                sig[k] = r
                x = sets[k]
                f[0, k] = mix64(np.array([np.add.reduce(mix64(x + np.uint64(1)))]))[0] ^ np.uint64(len(x))
                f[1, k] = np.bitwise_xor.reduce(mix64(x * np.uint64(0x9E3779B97F4A7C15)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(sig, pa.list_(pa.int32()))],
            names=["doc_id", "n_shingles", "f1", "f2", "sig"],
        )

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>")


def _bytes(column: pa.Array) -> list[bytes]:
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def meetings(reps: DataFrame, folder: str) -> DataFrame:
    """(key, node, n: members of the key, weight: members of all keys of the node, hub: heaviest node) of keys with several members."""

    def sketch(i: int):
        return [F.get("sig", F.lit(EACH * i + k)) for k in range(EACH)]

    keys = F.array(*[F.xxhash64(F.lit(i * SKETCHES + j), *sketch(i), *sketch(j)) for i, j in PAIRS])
    rows = reps.select(F.explode(keys).alias("key"), F.col("rep").alias("node"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialise(rows.join(several, "key"), f"{folder}/met")
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = materialise(met.join(weights, "node"), f"{folder}/weighed")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    return weighed.join(hubs, "key")


def hub_pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b) of members and the hubs of their keys; a hub is another one's member only where that is heavier."""
    return met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose minhashes and set sizes allow a link."""
    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    sizes = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return pairs.join(left, "a").join(right, "b").filter(sizes & (agree >= AGREE)).select("a", "b")


def _wanted(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids (node), each text of an id once."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return rows.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("doc_id", "text")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set) of the given nodes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(_bytes(batch.column(1)), size)
        cuts = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        values = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, values)], names=["node", "set"])

    return map_rows(_wanted(docs, nodes), run, "node long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) that are links by exact similarity of their ``sets`` (node, set)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", shared.alias("k"), (F.size("sa") + F.size("sb")).alias("n"))
    return materialise(counted.filter(F.col("k") * 100 >= PERCENT * (F.col("n") - F.col("k"))).select("a", "b"), f"{folder}/links")


def undecided(left: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, weight, component, largest: the key's largest component) of keys whose members are in several components."""
    placed = left.select("key", "node", "weight").join(found, "node", "left").select("key", "node", "weight", F.coalesce("component", "node").alias("component"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    keys = counts.groupBy("key").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return placed.join(keys, "key").select("key", "node", "weight", "component", "largest")


def further_pairs(left: DataFrame) -> DataFrame:
    """(a, b) of members outside the largest component with a random member inside and the heaviest one outside."""
    inside, who = F.col("component") == F.col("largest"), F.struct("node", "component")
    centres = left.groupBy("key").agg(F.max_by(F.when(inside, who), F.when(inside, F.xxhash64("node", "key"))).alias("x"), F.max_by(F.when(~inside, who), F.when(~inside, F.struct("weight", "node"))).alias("y"))
    met = left.filter(~inside).join(centres, "key").select("node", "component", F.explode(F.array("x", "y")).alias("c")).filter("component <> c.component")
    return met.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()


def rare_keys(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, weight): the rarest shingles of undecided members, as many as links cannot do without, where another member has them too.

    Two sets with 100 * intersection >= ``PERCENT`` * union share at least that part of either one. With shingles in one
    order (fewest members first), each set's first n - ceil(n * ``PERCENT`` / 100) + 1 so have one in common: nothing is lost,
    and members that share only what a whole crowd shares do not meet.
    """
    rows = sets.join(left.select("node").distinct(), "node", "left_semi").select("node", F.explode("set").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ordered = rows.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    needed = F.size("s") - F.ceil(F.size("s") * PERCENT / 100).cast("int") + 1
    first = ordered.select("node", F.explode(F.slice("s", F.lit(1), needed)).alias("x")).filter("x.n > 1")
    return first.select("x.key", "node", F.lit(0).cast("long").alias("weight"))


def group_members(left: DataFrame, folder: str) -> DataFrame:
    """(group, node, component, settled: in the group's largest component): keys that share a component are one group."""
    edges = left.filter("component <> largest").select(F.col("component").alias("a"), F.col("largest").alias("b"))
    up = materialise(components(edges, folder), f"{folder}/groups").select(F.col("node").alias("component"), F.col("component").alias("group"))
    members = left.select("node", "component").distinct().join(up, "component", "left").select(F.coalesce("group", "component").alias("group"), "node", "component")
    counts = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("group").agg(F.max(F.struct("m", "component"))["component"].alias("largest"))
    return members.join(largest, "group").select("group", "node", "component", (F.col("component") == F.col("largest")).alias("settled"))


def block_rows(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(group, x, y, own, node, component): each member once for each task (x, y: blocks to compare) it takes part in.

    A block holds members of one group, one class of set sizes and one side (in the largest component, or not).
    """
    sizes = reps.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"))
    rows = members.join(sizes, "node").withColumn("side", F.floor(F.log("n") / math.log(100 / PERCENT)).cast("long") * 2 + F.when(F.col("settled"), 1).otherwise(0))
    each = F.least(F.greatest(F.ceil(F.col("m") / BLOCKS), F.lit(BLOCK)), F.lit(MOST))
    counts = rows.groupBy("group", "side").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    counts = counts.select("group", "side", F.greatest(F.ceil(F.col("m") / each), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # one entry for each class of sizes and side: some hundred at most
    plans = counts.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("side", "blocks"))).alias("plan"))
    placed = rows.join(plans, "group")
    own = F.shiftleft("side", 32) + F.pmod(F.xxhash64("node"), F.try_element_at("plan", F.col("side")))
    open_ = F.col("side") % 2 == 0
    near = [F.when(open_ | F.lit(other == 0), (F.floor(F.col("side") / 2) + d) * 2 + other) for d in (-1, 0, 1) for other in (0, 1)]

    def blocks(side):
        n = F.coalesce(F.try_element_at("plan", side), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.shiftleft(side, 32) + b)).otherwise(F.array().cast("array<bigint>"))

    others = F.flatten(F.transform(F.filter(F.array(*near), lambda x: x.isNotNull()), blocks))
    dealt = placed.select("group", own.alias("own"), "node", "component", F.explode(others).alias("other"))
    return dealt.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "component")


def block_links(first: np.ndarray, nodes: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of one task that join components; ``first``: the member is in the first block (all are where a block meets itself)."""
    one = bool(first.all())
    sizes = np.array([len(s) for s in sets])
    coded = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.cumsum(np.append(0, sizes))
    mark = np.zeros(int(coded.max()) + 1, bool)
    label, out = np.unique(comps, return_inverse=True)[1], []
    begin = 0 if one else int(np.flatnonzero(~first)[0])  # members come in the order of their blocks
    rest = slice(int(cuts[begin]), None)
    for p in np.flatnonzero(first):
        q = np.arange(begin, len(nodes))
        q = q[(label[q] != label[p]) & (q > p) & (100 * np.minimum(sizes[q], sizes[p]) >= percent * np.maximum(sizes[q], sizes[p]))]
        if not len(q):
            continue
        own = coded[cuts[p] : cuts[p + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[coded[rest]], cuts[begin:-1] - cuts[begin], dtype=np.int64)[q - begin]
        mark[own] = False
        for x in q[100 * shared >= percent * (sizes[q] + sizes[p] - shared)]:
            if label[x] != label[p]:
                label[label == label[x]] = label[p]
                out.append((int(nodes[p]), int(nodes[x])))
    return out


def remaining_links(left: DataFrame, reps: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(a, b) of true links between components of undecided keys."""
    members = materialise(group_members(left, folder), f"{folder}/members")
    rows = block_rows(members, reps).join(sets, "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch | None:
            own, nodes, comps, sets = zip(*held, strict=True) if held else ((),) * 4
            first = np.array(own) == (key or (0, 0))[1]
            if len(held) < 2 or not first.any() or (key[1] != key[2] and first.all()):
                return None  # a block is empty
            found = block_links(first, np.array(nodes, np.int64), np.array(comps, np.int64), list(sets))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"]) if found else None

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *row, data in zip(*columns, batch.column(6), strict=True):
                if tuple(row[:3]) != key:
                    out = flush()
                    if out is not None:
                        yield out
                    key, held = tuple(row[:3]), []
                held.append((*row[3:], data.values.to_numpy()))
        out = flush()
        if out is not None:
            yield out

    task = ("group", "x", "y")
    dealt = rows.select(*task, "own", "node", "component", "set").repartition(partitions(left.sparkSession), *task).sortWithinPartitions(*task, "own", "node")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def with_links(found: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """Components (node, component) after more links (a, b): only links between components count, and only those join anew."""
    ends = [found.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in ("a", "b")]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = materialise(edges.filter("a <> b").distinct(), f"{folder}/edges")
    if edges.isEmpty():
        return found
    up = materialise(components(edges, folder), f"{folder}/up")
    moved = found.join(up.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return materialise(moved.unionAll(up), f"{folder}/found")


def linked(docs: DataFrame, reps: DataFrame, size: int, folder: str) -> DataFrame:
    """(node, component) of the representatives that are linked with a smaller one."""
    spark = docs.sparkSession
    met = materialise(meetings(reps, folder), f"{folder}/hubs")
    for name in ("met", "weighed"):
        remove(spark, f"{folder}/{name}")
    # the sets of all that share a key with another one, cut and hashed once
    sets = materialise(sets_of(docs, met.select("node"), size), f"{folder}/sets")
    links = confirmed(agreeing(hub_pairs(met), reps), sets, f"{folder}/first")
    found = materialise(components(links, f"{folder}/first"), f"{folder}/found")
    left = materialise(undecided(met.filter("n > 2"), found), f"{folder}/left")
    if left.isEmpty():
        return found
    found = with_links(found, confirmed(agreeing(further_pairs(left), reps), sets, f"{folder}/further"), f"{folder}/further")
    left = materialise(undecided(left, found), f"{folder}/left-2")
    if left.isEmpty():
        return found
    left = materialise(undecided(rare_keys(left, sets), found), f"{folder}/left-3")
    if left.isEmpty():
        return found
    links = materialise(remaining_links(left, reps, sets, f"{folder}/blocks"), f"{folder}/blocks/links")
    return with_links(found, links, f"{folder}/blocks")


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``size`` words a shingle."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    signed = materialise(sign(docs, size), f"{folder}/signed")
    same = ("f1", "f2", "n_shingles")
    reps = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = materialise(reps, f"{folder}/reps")
    joined = linked(docs, reps, size, folder)
    names = reps.select(*same, "rep").join(joined, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = signed.drop("sig").join(names, list(same), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The row with the smallest id of each component, with its own columns.

    Rows count by (doc_id, text), so a repeated id with another text is another
    document; of rows equal in both one is kept. Rows with a null id all are.
    """
    # the input travels as one column, so that no name of it meets one of ours
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    packed = docs.select(row.alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    named = docs.filter(F.col("doc_id").isNotNull()).select(row.alias("_row"), "doc_id", "text")
    found = near_duplicates(named.select(F.col("_row").alias("doc_id"), "text"), size).select(F.col("doc_id").alias("_row"), "component_id")
    rows = named.groupBy("_row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    placed = materialise(found.distinct().join(rows, "_row"), f"{shared_dir(docs.sparkSession)}/placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    gone = placed.select("_row").join(first, "_row", "left_anti")
    left = packed.join(gone, "_row", "left_anti")
    again = placed.filter("n > 1").select("_row")
    out = left.join(again, "_row", "left_anti").unionByName(left.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return out.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
