"""Numbers without a global window, block masks by pieces, context windows over numbered rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions.order import numbered
from scriptloom.model import QaRules
from scriptloom.operators import extract as E
from scriptloom.operators import qa


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_ties_nulls_and_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, _place int").repartition(7)
    out = numbered(df, [F.col("a").desc_nulls_last(), "b"], "n")
    got = sorted(out.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(500)) and out.columns == ["a", "b", "_place", "n"]
    key = lambda r: (r["a"] is None, -(r["a"] or 0), r["b"] is not None, r["b"] or "")
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    assert sorted(r["_place"] for r in got) == list(range(500))
    assert "SinglePartition" not in plan(out)
    assert numbered(df.limit(0), ["a"], "n").collect() == []
    # one value everywhere: ties are dealt too
    same = numbered(df.withColumn("c", F.lit(1)), ["c"], "n")
    assert sorted(r["n"] for r in same.collect()) == list(range(500))


def fold(lines):
    """in_python and in_screen, line by line."""
    python = screen = None
    out = []
    for indent, blank, header, hides, heads in lines:
        if python is not None and (blank or indent > python):
            out.append((True, False))
            continue
        python = None
        if header:
            python = indent
        if header or hides:
            out.append((False, False))
            continue
        if screen is not None and (blank or indent > screen):
            out.append((False, True))
            continue
        screen = indent if heads else None
        out.append((False, False))
    return out


def script(rng, n):
    out = []
    for _ in range(n):
        kind = rng.random()
        blank = kind < 0.15
        out.append((0 if blank else rng.randrange(4), blank, 0.15 <= kind < 0.3, 0.3 <= kind < 0.4, 0.4 <= kind < 0.55))
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7, 1000])
def test_blocks_by_pieces_equal_a_fold(chunk):
    rng = random.Random(chunk)
    for _ in range(150):
        lines = script(rng, 40)
        indent = np.array([x[0] for x in lines], np.int32)
        bits = np.array([E.BLANK * b + E.OPENS * h + E.HIDES * (x and not b) + E.HEADS * (s and not b) for _, b, h, x, s in lines], np.int32)
        for settle in (E._python_then_screens, E._screens):
            done, enter = [], E.NONE
            for k in range(0, len(lines), chunk):
                piece = slice(k, k + chunk)
                _, least, left = E.scan_blocks(indent[piece], bits[piece])
                done.append(settle(indent[piece], bits[piece], enter))
                enter = min(enter, left) if enter < least else left
            bits = np.concatenate(done)
        assert [(bool(b & E.PYTHON), bool(b & E.SCREEN)) for b in bits] == fold(lines)


@pytest.mark.parametrize("chunk", [3, 7, 1 << 16])
def test_masked_lines_of_files_cut_in_pieces(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows, expected = [], []
    for name in ("a", "b", None):
        lines = script(rng, 60)
        flags = fold([(i, b, h, x and not b, s and not b) for i, b, h, x, s in lines])
        for k, ((indent, blank, header, hides, heads), f) in enumerate(zip(lines, flags, strict=True), 1):
            # screens begin a line's own text, so a header may be indented
            body = "" if blank else "python:" if header else "# note" if hides else "screen s:" if heads else 'x "y"'
            rows.append((name, k, "" if blank else " " * indent + body))
            expected.append((name, k, *f))
    found = E.masked(spark.createDataFrame(rows, "file string, line int, raw string").repartition(5), True)
    got = [(r["file"], r["line"], r["in_python"], r["in_screen"]) for r in found.select("file", "line", "in_python", "in_screen").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("piece", [3, 1 << 16])
def test_windows_by_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(qa, "CHUNK", piece)
    rng = random.Random(piece)
    rules = QaRules.parse({"groups": {"x": ["a"], "y": ["b", "c"]}})
    rows = [(f"t{k}", rng.choice("abcd"), rng.choice(["f", "g", None]), rng.randrange(25), "say", k) for k in range(150)]
    df = spark.createDataFrame(rows, "text string, speaker string, file string, line int, kind string, seq long").repartition(4)
    got = {r["seq"]: (r["near_0"], r["near_1"]) for r in qa.window_counts(df, rules.groups, ["x", "y"], 4).collect()}
    expected = {}
    for name in ("f", "g", None):
        mine = sorted((r for r in rows if r[2] == name), key=lambda r: (r[3], r[5]))
        last = {r[3]: k for k, r in enumerate(mine)}
        for r in mine:
            around = mine[max(0, last[r[3]] - 4) : last[r[3]] + 5]
            expected[r[5]] = (sum(x[1] == "a" for x in around), sum(x[1] in "bc" for x in around))
    assert got == expected
