"""Near duplicates, components and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptloom.llm import minhash as M
from scriptloom.llm.common import partitions, shared_dir
from scriptloom.llm.components import _with_least, components

from .conftest import brute_components, brute_sets, odd_texts, words


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_texts(seed=5, groups=12):
    """Groups of texts with a rising number of changed words, chains included."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        w = words(1000 + g, 60 + 20 * g, 5000).split()
        for _ in range(8):
            out.append(" ".join(w))
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, size):
    rows = near_texts() + [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a b c"), (6, " \n")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(frame(spark, rows), size).collect()}
    ids, texts = zip(*rows, strict=True)
    sets = brute_sets(texts, size)
    least = brute_components(ids, sets)
    assert found == {d: (len(s), c, d == c) for d, s, c in zip(ids, sets, least, strict=True)}


def template_texts(seed, n, shared=120, own=60, copies=40):
    """Pages of one template that do not link, and near copies of some of them."""
    rng = random.Random(seed)
    frame_words = words(seed, shared, 5000).split()
    out = []
    for k in range(n):
        out.append(" ".join([*frame_words, *(f"u{rng.randrange(10**6)}" for _ in range(own))]))
    for k in range(copies):
        w = out[rng.randrange(n)].split()
        w[-1 - rng.randrange(own)] = f"edit{k}"
        out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("block", "blocks"), [(128, 64), (3, 1)])
def test_keys_of_many_components(spark, monkeypatch, block, blocks):
    rows = template_texts(3, 150) + near_texts(seed=9, groups=3)[:20]
    rows = [(k, t) for k, (_, t) in enumerate(rows, 1)]
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BLOCKS", blocks)
    ids, texts = zip(*rows, strict=True)
    found = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(frame(spark, rows), 4).collect()}
    assert found == dict(zip(ids, brute_components(ids, brute_sets(texts, 4)), strict=True))


def test_blocks_alone_find_all_links(spark, monkeypatch):
    """Without hubs of keys of three or more members, and without further centres."""
    rows = near_texts(seed=9, groups=5)
    ids, texts = zip(*rows, strict=True)
    whole = M.hub_pairs
    monkeypatch.setattr(M, "hub_pairs", lambda met: whole(met.filter("n = 2")))
    monkeypatch.setattr(M, "further_pairs", lambda left: left.selectExpr("node AS a", "node AS b").limit(0))
    monkeypatch.setattr(M, "BLOCK", 5)
    found = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(frame(spark, rows), 4).collect()}
    assert found == dict(zip(ids, brute_components(ids, brute_sets(texts, 4)), strict=True))


def test_tasks_of_a_template_crowd_are_bounded(spark):
    """5,000 pages of one template that do not link: no task holds more than two blocks, and a member is sent as often as there are blocks."""

    n = 5000
    rng = random.Random(4)
    shared = words(4, 90, 5000).split()
    docs = frame(spark, [(k, " ".join([*shared, *(f"u{rng.randrange(10**6)}" for _ in range(50))])) for k in range(n)]).repartition(4)
    folder = shared_dir(spark)
    reps = M.materialise(M.sign(docs, 5).select(F.col("doc_id").alias("rep"), "n_shingles", "sig"), f"{folder}/reps")
    met = M.meetings(reps, folder)
    left = M.materialise(M.undecided(met.filter("n > 2"), spark.createDataFrame([], "node long, component long")), f"{folder}/left")
    members = M.materialise(M.group_members(left, folder), f"{folder}/members")
    dealt = M.block_rows(members, reps)
    assert members.count() > 4500 and members.select("group").distinct().count() == 1
    assert dealt.groupBy("group", "x", "y").count().agg(F.max("count")).first()[0] < 3 * M.BLOCK
    assert dealt.count() <= members.count() * (n // M.BLOCK + 4)
    assert M.near_duplicates(docs, 5).select("component_id").distinct().count() == n


def test_a_crowd_with_words_of_its_own_makes_no_groups(spark):
    """Pages of one template that do not link meet in nothing; copies planted among them do, and all are found."""
    for n in (400, 800):
        rows = template_texts(n, n, copies=30)
        docs = frame(spark, rows).repartition(4)
        folder = shared_dir(spark)
        reps = M.materialise(M.sign(docs, 5).select(F.col("doc_id").alias("rep"), "n_shingles", "sig"), f"{folder}/reps")
        met = M.materialise(M.meetings(reps, folder), f"{folder}/hubs")
        none = spark.createDataFrame([], "node long, component long")
        left = M.undecided(met.filter("n > 2"), none)
        sets = M.materialise(M.sets_of(docs, met.select("node"), 5), f"{folder}/all-sets")
        again = M.undecided(M.rare_keys(left, sets), none)
        assert left.select("node").distinct().count() > 0.8 * n and again.select("node").distinct().count() <= 120
        ids, texts = zip(*rows, strict=True)
        found = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs, 5).collect()}
        assert found == dict(zip(ids, brute_components(ids, brute_sets(texts, 5)), strict=True))


def test_odd_documents(spark, odd, nothing):
    out = M.near_duplicates(odd, 5).collect()
    assert len(out) == len(odd_texts())
    by = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert by[1] == by[2] == by[9007199254740993] == -5 and by[3] == 3 and by[10] == 10
    kept = M.keep_one(odd, 5)
    assert kept.columns == odd.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert -5 in left and 1 not in left and 2 not in left and left.count(None) == 2
    assert M.near_duplicates(nothing, 5).count() == 0 and M.keep_one(nothing, 5).count() == 0


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(3)
    for round_ in range(60):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[: rng.integers(25, 41)], rng.integers(0, 1 << 60, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(9)]
        plain = [set(x.tolist()) for x in sets]
        first = np.ones(9, bool) if round_ % 2 else np.arange(9) < 4
        comps = rng.integers(0, 9, 9) if round_ % 3 else np.arange(9)
        wanted = [(p, q) for p in range(9) for q in range(p) if (round_ % 2 or first[p] != first[q]) and 100 * len(plain[p] & plain[q]) >= 80 * len(plain[p] | plain[q])]

        def parts(links, comps=comps):
            name = dict(enumerate(comps.tolist()))
            for p, q in links:
                old, new = name[p], name[q]
                name = {k: new if c == old else c for k, c in name.items()}
            return {frozenset(k for k in name if name[k] == c) for c in name.values()}

        found = M.block_links(first, np.arange(9), comps, sets)
        assert parts(found) == parts(wanted) and set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, wanted)))


def test_shingles_do_not_depend_on_the_batch():
    texts = [t.encode() for t in ("A b c d e f", "", " x ", "a B\tc d", "é é é é é")]
    together = M.shingle_sets(texts, 4)
    assert all(np.array_equal(s, M.shingle_sets([t], 4)[0]) for s, t in zip(together, texts, strict=True))
    assert np.array_equal(M.shingle_sets([b"A B c D"], 4)[0], together[3])


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, 300 + k) for k in range(50)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert all(found[n] == root(n) for n in found)
    assert {n for n in parent if root(n) != n} <= set(found)


def test_edges_of_a_star_are_dealt_to_many_tasks(spark):
    edges = [(500, k) for k in range(1000) if k != 500]
    found = _with_least(spark.createDataFrame([*edges, (3000, 2000)], "a long, b long"))
    assert {(r["a"], r["b"], r["m"]) for r in found.collect()} == {(500, k, 0) for _, k in edges} | {(3000, 2000, 2000)}
    shares = found.filter("a = 500").groupBy(F.pmod(F.xxhash64("b"), F.lit(partitions(spark))).alias("s")).count().collect()
    assert len(shares) == partitions(spark) and max(r["count"] for r in shares) < 2 * len(edges) / len(shares)
    linked = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert linked == {k: 0 for k in range(1, 1000)}


# ---- pipeline --------------------------------------------------------------


def test_stages_on_odd_documents(spark, odd, nothing, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert out.count() <= odd.count() and stage(spark, nothing, sf).count() == 0
        # the values of columns that are called like the operators' own are carried
        own = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "n_chars")]
        assert {tuple(r) for r in out.select(*[f"`{c}`" for c in own]).collect()} <= {tuple(r) for r in odd.select(*[f"`{c}`" for c in own]).collect()}, name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, nothing, sf).count() == 0
    pieces = pack(spark, odd, sf).collect()
    # every row is packed whole, its end id with it; null and empty texts are that id alone
    assert sum(p["length"] for p in pieces if p["doc_id"] in (3, 4)) == 2
    assert {p["doc_id"] for p in pieces} == {d for d, _ in odd_texts()}
    ends = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert all(a[1] + a[2] == b[1] for a, b in zip(ends, ends[1:], strict=False) if a[0] == b[0])


def test_pipeline_equals_its_parts(spark, sf):
    from .test_small_ops import D, Q, brute_lines, brute_quality

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = {r["doc_id"] for r in Q.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).filter("kept").collect()}
    assert all(brute_quality(t)[0] >= 50 for d, t in docs if d in kept)
    after = {d: t for d, t in brute_lines([x for x in docs if x[0] in kept]).items() if t.strip(" \t\n\x0b\x0c\r")}
    ids = sorted(after)
    least = brute_components(ids, brute_sets([after[d] for d in ids], 5))
    unique = {d for d, c in zip(ids, least, strict=True) if d == c}
    items = [D.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d in unique if not any(i in D.normal(after[d]) for i in items)}
    pieces = corpus_pipeline.run(spark, sf).collect()
    found = {p["doc_id"] for p in pieces}
    # a stretch of an item is enough for the stage, so it may take more than whole items
    whole_item = unique - clean
    assert not found & whole_item and found <= clean
    # what else it takes shares 16 bytes with an item: 80 bytes with four edits hold as many unedited in a row
    for d in clean - found:
        text = D.normal(after[d])
        assert any(i[k : k + 16] in text for i in items for k in range(len(i) - 15)), d


def test_candidate_loss_at_the_threshold():
    """Pairs of similarity 0.8 that share a key (two sketches whole) are dropped by the signature filter less than once in 10^7."""
    from math import comb

    s, dropped = 0.8, 0.0
    for whole in range(2, M.SKETCHES + 1):
        for half in range(M.SKETCHES - whole + 1):
            if 2 * whole + half < M.AGREE:
                rest = M.SKETCHES - whole - half
                dropped += comb(M.SKETCHES, whole) * comb(M.SKETCHES - whole, half) * s ** (2 * whole) * (2 * s * (1 - s)) ** half * (1 - s) ** (2 * rest)
    assert dropped < 1e-7


def test_keep_one_of_repeated_ids(spark):
    a, b, c = (words(k, 80, 5000) for k in (21, 22, 23))
    rows = [(1, a), (5, a + " tail"), (5, b), (6, b), (7, c), (7, c), (8, c.upper()), (9, None), (9, None), (None, a)]
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in M.keep_one(frame(spark, rows), 5).collect()))
    assert found == sorted([(1, a), (5, b), (7, c), (9, ""), (0, a)])
