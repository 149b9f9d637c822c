"""Exact substrings, resampling and phrases, held against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import phrases as P
from scriptloom.llm import resample as R
from scriptloom.llm import suffixes as S

from .conftest import odd_texts, words

SHAPE = "doc_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- exact substrings ------------------------------------------------------


def brute_substrings(rows, length):
    """(n_bytes, n_removed, n_spans, kept) of each row, string by string."""
    key = lambda d: -(2**63) if d is None else d
    texts = [(key(d), (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, d), d)
    out = []
    for (row_id, _), (d, b) in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < d:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((row_id, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def substrings(df, length=50):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.dedup_substrings(df, length).collect()), key=repr)


def passages(seed, n=120):
    """Documents that share pieces of every length around 50 bytes, at every offset, and near copies."""
    rng = random.Random(seed)
    letters = "abcdé ü.\n"
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 46, 47, 48, 49, 50, 51, 60, 200]))) for _ in range(25)]
    out = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append("".join(rng.choice("xyzw") for _ in range(rng.randrange(20))))
            parts.append(rng.choice(pool))
        out.append((rng.randrange(10**6) if k % 9 else k, "".join(parts)))
    return out


@pytest.mark.parametrize(("length", "chunk"), [(50, 4 << 20), (50, 900), (23, 900)])
def test_substrings_equal_brute_force(spark, monkeypatch, length, chunk):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    rows = passages(length + chunk)
    assert substrings(spark.createDataFrame(rows, SHAPE).repartition(3), length) == brute_substrings(rows, length)


def test_substrings_of_odd_documents(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 5_000)
    rows = [(d, t if t is None or len(t) < 10_000 else t[:3_000]) for d, t in odd_texts()]
    df = spark.createDataFrame(rows, SHAPE)
    assert substrings(df) == brute_substrings(rows, 50)
    whole = {r["doc_id"]: r for r in S.dedup_substrings(odd).collect()}
    assert whole[7]["n_bytes"] == 300_000 and whole[7]["n_removed"] == 0  # repeats inside a document stay
    assert whole[2]["n_removed"] == whole[2]["n_bytes"] and whole[1]["n_removed"] == whole[1]["n_bytes"]  # the null id is the smallest
    assert S.dedup_substrings(nothing).collect() == []
    with pytest.raises(ValueError, match="length"):
        S.dedup_substrings(odd, 19)


def test_cover_meets_every_pair():
    """Any two positions have one offset below the period at which both are in the sample."""
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any((a + k) % S.PERIOD in S.COVER and (b + k) % S.PERIOD in S.COVER for k in range(S.PERIOD))


def test_equal_bytes_of_a_hot_passage(spark, monkeypatch):
    """One passage in every document, in many chunks: only the first keeps it, and nothing else goes."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 2_000)
    hot = words(9, 20)
    rows = [(k, f"{words(1000 + k, 10, 10**9)} {hot} {words(5000 + k, 10, 10**9)}") for k in range(300)]
    got = {r["doc_id"]: r for r in S.dedup_substrings(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()}
    assert got[0]["n_removed"] == 0
    assert all(got[k]["n_spans"] == 1 and len(hot) <= got[k]["n_removed"] <= len(hot) + 16 for k in range(1, 300))


# ---- resampling ------------------------------------------------------------


def brute_resample(rows, target, longest, buckets, least, percent, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    found = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for (d, _), (n_words, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, n_words])
    fits = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(fits[: len(fits) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    rows = [(k * 7, words(k, 5 + k % 60, 300).replace("q", "É-")) for k in range(200)] + [(3, None), (4, ""), (5, "-- !"), (None, words(3, 40))]
    target = [words(k, 30, 40) for k in range(10)] + [None, ""]
    got = R.resample(spark.createDataFrame(rows, SHAPE).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest, 97, 20, 25, "x")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, target, longest, 97, 20, 25, "x")


def test_resampling_of_odd_documents(spark, odd, nothing):
    got = R.resample(odd, nothing, percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == len(odd_texts())
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert R.resample(nothing, odd).collect() == []


# ---- phrases ---------------------------------------------------------------


def brute_phrases(rows, longest, least, percent, top):
    f, n = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = ("und" if lang is None else lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    rows = []
    for (lang, w), a in found.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(g == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in found.items())
        if not inside:
            rows.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out = []
    for lang in n:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], k, *r[1:]) for k, r in enumerate(best, 1)]
    return sorted(out)


def spoken(seed, n=150):
    rng = random.Random(seed)
    stock = [words(k, rng.randrange(2, 8), 30) for k in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            parts += [rng.choice(stock), rng.choice([" ", ". ", "\n", ",", "\t", " É "]), words(rng.random(), rng.randrange(4), 25)]
        out.append((rng.choice(["en", "de", None, "und", ""]), "".join(parts).replace("w1", "W1")))
    return out


@pytest.mark.parametrize(("longest", "least", "percent", "top", "chunk"), [(5, 9, 100, 2000, 8 << 20), (5, 6, 60, 7, 700), (2, 9, 100, 50, 700), (3, 9, 100, 50, 8 << 20)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, least, percent, top, chunk):
    monkeypatch.setattr(P, "CHUNK_BYTES", chunk)
    rows = spoken(least)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in P.collocations(df, longest, least, percent, top).collect()) == brute_phrases(rows, longest, least, percent, top)


def test_phrases_of_odd_documents(spark, odd, nothing):
    assert P.collocations(nothing).collect() == []
    rows = [(None, t) for _, t in odd_texts() if t is None or len(t) < 10_000]
    got = P.collocations(odd.filter("text IS NULL OR length(text) < 10000").withColumn("lang", F.lit(None).cast("string")), 3, 3)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 3, 3, 100, 2000)


def test_products_beyond_64_bits(spark):
    """a, n, l and r of 10^13: the score is exact."""
    big = 10**13
    found = spark.createDataFrame([("en", "a b", big - 7, 2)], "lang string, phrase string, f long, size int")
    single = spark.createDataFrame([("en", "a", big - 3), ("en", "b", big - 1), ("en", "c", big)], "lang string, phrase string, f long")
    r = P.scored(found, single).first()
    assert r["score"] == 1000 * (big - 7) * (3 * big - 4) // ((big - 3) * (big - 1)) and r["n"] == 3 * big - 4


def test_phrases_hold_few_chunks_and_small_batches(spark, tmp_path, monkeypatch):
    """One task's chunks are in several row groups, and no table is made with larger batches than BATCH_BYTES."""
    import pyarrow.parquet as pq

    seen, write = [], P.materialise
    monkeypatch.setattr(P, "materialise", lambda *a: (seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))), write(*a))[1])
    text = " ".join(f"w{k}" for k in range(500_000))
    docs = spark.createDataFrame([(k, "en", text) for k in range(12)], "doc_id long, lang string, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found, _ = P.candidates(docs, 3, 1000, f"file://{tmp_path}/t")
    assert found.count() == 0 and len(seen) == 5 and max(seen) <= 8 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in (tmp_path / "t" / "chunks").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(groups) == 12 and len(groups) > 1


def test_phrases_add_up_occurrences_that_wait(spark):
    """One bucket's rows come to more than what is held; equal ones add up, and what is rare in each row still counts."""
    ids = np.arange(1, 27_001, dtype="<i8")
    body = b"".join(c.astype("<i8").tobytes() for c in (ids, ids + 1, ids * 0, ids * 0, ids * 0 + 1))
    assert 30 * len(body) > 24 << 20
    rows = spark.createDataFrame([(0, k, bytearray(body)) for k in range(30)] + [(1, 0, bytearray(body))], "bucket int, chunk long, body binary")
    got = P.grown(rows, 5, 30).collect()
    assert sorted((tuple(r["ids"]), r["f"]) for r in got) == [((k, k + 1), 30) for k in range(1, 27_001)]
