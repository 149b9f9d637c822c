"""JSON sources cut into splits of any size, and files written by executors."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.model import ENTRY
from scriptloom.sources import members as M
from scriptloom.sources import scripts

ODD = 'ab,"\\{}[]:é\n\t \x1f\u2028'


def odd(rng):
    return "".join(rng.choice(ODD) for _ in range(rng.randrange(9)))


@pytest.fixture
def splits(spark):
    """Sets the bytes of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield put
    for n, v in before.items():
        spark.conf.set(n, v)


def whole(spark, path, kind):
    """The file as one value in one task."""
    rows = spark.read.text(path, wholetext=True)
    if kind == "array":
        rows = rows.select(F.posexplode(F.from_json("value", f"array<{ENTRY.simpleString()}>")).alias("seq", "e"))
        return sorted((r["seq"], tuple(r["e"])) for r in rows.collect())
    last = {}
    for k, v in json.loads(open(path, encoding="utf-8").read(), object_pairs_hook=list):
        last.setdefault(k, [len(last), v])[1] = v
    return {k: v for k, (_, v) in last.items()}


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_entries_by_splits(spark, splits, tmp_path, size):
    rng = random.Random(size)
    rows = [{"text": odd(rng), "speaker": odd(rng), "file": odd(rng), "line": rng.randrange(99), "kind": "say", "more": [odd(rng), {odd(rng): 1}]} for _ in range(12)]
    path = str(tmp_path / "strings.json")
    for indent in (None, 2):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=indent is None, indent=indent)
        expected = whole(spark, path, "array")
        splits(size)
        got = sorted((r["seq"], tuple(r[c] for c in ENTRY.names)) for r in scripts.read_entries(spark, path).collect())
        assert got == expected and len(got) == 12


@pytest.mark.parametrize("size", [3, 64])
def test_progress_by_splits(spark, splits, tmp_path, size):
    rng = random.Random(size)
    pairs = [(odd(rng), odd(rng)) for _ in range(20)]
    path = str(tmp_path / "progress.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write("{" + ",\n ".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in pairs) + "}\n")
    splits(size)
    got = {r["text"]: (r["tr"], r["pos"]) for r in scripts.read_progress(spark, path).collect()}
    place = {}
    for k, (text, _) in enumerate(pairs):
        place.setdefault(text, k)
    assert got == {k: (v, place[k]) for k, v in whole(spark, path, "object").items()}


def test_odd_json_files(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text, encoding="utf-8")
        return scripts.read_progress(spark, str(path)).count()

    assert [read(x) for x in ("{}", " { }\n", '{"a": "b"}')] == [0, 0, 1]
    assert scripts.read_progress(spark, str(tmp_path / "none.json")).count() == 0
    for bad in ("", '{"a": "b', '{"a": {"b": 1}'):
        with pytest.raises(ValueError, match="JSON"):
            read(bad)


def rows_of_splits(data, size):
    """What a text reader makes of a file cut every ``size`` bytes: a row belongs to the split it begins in, or the one before where it begins there exactly."""
    out, p = {}, 0
    while p < len(data):
        q = data.find(b",", p)
        q = len(data) if q < 0 else q
        out.setdefault(max(0, (p - 1) // size) * size, []).append(data[p:q])
        p = q + 1
    return out


def test_members_at_every_cut():
    rng = random.Random(3)

    def value(depth=0):
        r = rng.random()
        if r < 0.6 or depth > 2:
            return odd(rng)
        if r < 0.7:
            return rng.choice([1, None, True, 2.5])
        return [value(depth + 1) for _ in range(rng.randrange(3))] if r < 0.85 else {odd(rng): value(depth + 1) for _ in range(rng.randrange(3))}

    for t in range(60):
        v = [value() for _ in range(rng.randrange(6))] if t % 2 else {odd(rng): value() for _ in range(rng.randrange(6))}
        data = json.dumps(v, ensure_ascii=t % 3 == 0, indent=rng.choice([None, 1])).encode()
        for size in range(1, len(data) + 2):
            splits = {s: b",".join(r) + b"," for s, r in rows_of_splits(data, size).items()}
            found = []
            for start, body in splits.items():
                for k in (0, 1):
                    s = M.State(bool(k))
                    M.advance(s, np.frombuffer(body, np.uint8))
                    found.append({"start": start, "entered": k, "string": s.string, "depth": s.depth, "depths": list(s.commas), "commas": list(s.commas.values())})
            places, got = M.entered(found), {}
            for start, body in splits.items():
                c = M.Cutter(*places[start])
                for place, text, _ in [*c.feed(body), *c.rest()]:
                    got[place] = got.get(place, b"") + text
            got = [got[k] for k in sorted(got) if got[k].strip()]
            if isinstance(v, list):
                assert [json.loads(x) for x in got] == v
            else:
                assert [json.loads(b"{" + x + b"}") for x in got] == [{a: b} for a, b in v.items()]


def test_files_are_what_one_writer_makes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(odd(rng), odd(rng), "f", k, "say", k) for k in range(40)]
    names = ENTRY.names
    entries = spark.createDataFrame(rows, "text string, speaker string, file string, line int, kind string, seq long").repartition(7)
    target = tmp_path / "deep" / "strings.json"
    assert scripts.write_entries(entries, str(target)) == 40
    assert target.read_text(encoding="utf-8") == json.dumps([dict(zip(names, r, strict=False)) for r in rows], ensure_ascii=False, indent=2)
    back = sorted(scripts.read_entries(spark, str(target)).collect(), key=lambda r: r["seq"])
    assert [tuple(r) for r in back] == rows
    progress = spark.createDataFrame([(f"{k}{odd(rng)}", odd(rng), k) for k in range(30)], "text string, tr string, pos long")
    flat = {r["text"]: r["tr"] for r in sorted(progress.collect(), key=lambda r: r["pos"])}
    target = tmp_path / "progress.json"
    for _ in range(2):  # an existing file is replaced
        scripts.write_progress(progress.repartition(5), str(target))
        assert target.read_text(encoding="utf-8") == json.dumps(flat, ensure_ascii=False, indent=2)
    assert scripts.write_progress(progress.limit(0), str(target)) == 0
    assert target.read_text(encoding="utf-8") == "{}"
    assert sorted(os.listdir(tmp_path)) == ["deep", "progress.json"] and os.listdir(tmp_path / "deep") == ["strings.json"]


def test_named_files(spark, tmp_path):
    rows = [(f"a/{k % 3}é.txt", k, f"line {k}") for k in range(5000)]
    rendered = spark.createDataFrame(rows, "path string, ord long, line string").repartition(6)
    out = scripts.write_rendered(rendered, str(tmp_path))
    assert out == [f"{tmp_path}/a/{k}é.txt" for k in range(3)]
    for k in range(3):
        assert (tmp_path / "a" / f"{k}é.txt").read_text(encoding="utf-8") == "".join(f"line {j}\n" for j in range(k, 5000, 3))
    assert sorted(os.listdir(tmp_path / "a")) == [f"{k}é.txt" for k in range(3)]


def test_large_files_are_read_by_splits(spark, tmp_path, monkeypatch):
    """Small splits of one large file give the lines that the whole text gives, with marks, bad bytes and all breaks."""
    rng = random.Random(7)
    bodies = []
    for mark in (b"", b"\xef\xbb\xbf"):
        for end in (b"", b"\n", b"\r", b"\r\n", b"x"):
            parts = [rng.choice([b"a", b"\xc3\xa9", b"\xff", b"", b" b ", b"\xef\xbb\xbf"]) + rng.choice([b"\n", b"\r\n", b"\r", b"\n\n", b"\r\r\n"]) for _ in range(60)]
            bodies.append(mark + b"".join(parts) + b"tail" + end)
    for k, body in enumerate(bodies):
        (tmp_path / f"{k:02d}.rpy").write_bytes(body)
    (tmp_path / "small.rpy").write_bytes(b"a\nb")
    whole = sorted(map(tuple, scripts.read_lines(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(scripts, "LARGE", 10)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("7b", "50b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b")
            rows = scripts.read_lines(spark, str(tmp_path))
            assert rows.schema.simpleString() == "struct<file:string,line:int,raw:string>"
            assert sorted(map(tuple, rows.collect())) == whole
            if size == "7b":
                assert rows.rdd.getNumPartitions() > 2 * len(bodies)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
