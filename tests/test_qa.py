import pytest

from scriptloom.model import Profile, QaRules, load_rules
from scriptloom.operators import qa

ENTRY = "text string, speaker string, file string, line int, kind string, seq long"


def entries(spark, rows):
    return spark.createDataFrame([(t, s, f, n, "say", k) for k, (t, s, f, n) in enumerate(rows)], ENTRY)


def progress(spark, pairs):
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs.items())], "text string, tr string, pos long")


def labels(df):
    return [(r["category"], r["label"], r["seq"]) for r in df.orderBy("seq", "check_ord").collect()]


def test_technical(spark):
    e = entries(spark, [("a", "x", "f", 1), ("b", "x", "f", 2), ("{b}z{/b} [v] [v]", "x", "f", 3), ("ok [q]", "x", "f", 4), ("nbsp", "x", "f", 5)])
    p = progress(spark, {"b": "  ", "{b}z{/b} [v] [v]": "z", "ok [q]": "[q] [extra] {i}", "nbsp": "\u00a0"})
    found = labels(qa.issues(e, p, technical_only=True))
    assert found == [(1, "MISSING", 0), (1, "MISSING", 1), (1, "TAG:{/b},{b}", 2), (1, "VAR:[v]", 2), (1, "MISSING", 4)]


def test_phrasing(spark):
    e = entries(spark, [("x" * 21, "s", "f", 1), ("y" * 20, "s", "f", 2), ("hello", "s", "f", 3), ("z" * 25, "s", "f", 4)])
    p = progress(spark, {"x" * 21: "αβγδε", "y" * 20: "α", "hello": "Keep wordy thing again keep wordy", "z" * 25: "α" * 8})
    found = labels(qa.issues(e, p, keep=["KEEP", "two words"]))
    assert found == [(4, "short?", 0), (4, "roman:wordy,thing,again", 2)]


RULES = {"window": 10, "groups": {"ga": ["aa"], "gb": ["bb"]}, "roman_check": False, "rules": [{"name": "r", "category": 3, "pattern": "Q", "speakers": ["mc"], "near": {"group": "ga", "min": 2, "dominant_over": ["gb"]}}]}


@pytest.mark.parametrize(("before", "after", "fires"), [(["aa", "aa"], ["bb"], True), (["aa", "aa"], ["bb"] * 3, False), (["aa"], [], False)])
def test_dominance(spark, before, after, fires):
    who = [*before, "mc", *after]
    e = entries(spark, [(f"t{k}", w, "f", k) for k, w in enumerate(who)])
    p = progress(spark, {f"t{k}": "Q" for k in range(len(who))})
    assert bool(labels(qa.issues(e, p, QaRules.parse(RULES)))) is fires


def test_rule_options(spark):
    rows = [("same", "mc", "f", 1), ("same", "mc", "f", 2), ("(aside)", "mc", "f", 3), ("other", "zz", "f", 4)]
    p = progress(spark, {"same": "Q", "(aside)": "Q", "other": "Q"})

    def run(**rule):
        config = QaRules.parse({"roman_check": False, "groups": {"g": ["zz"]}, "rules": [{"name": "r", "pattern": "Q(?!x)", **rule}]})
        return [s for _, _, s in labels(qa.issues(entries(spark, rows), p, config))]

    assert run() == [0, 2, 3]
    assert run(dedupe=False) == [0, 1, 2, 3]
    assert run(skip_monologue=True) == [0, 3]
    assert run(speakers_group="g") == [3]
    assert run(speakers_group="unknown") == []
    assert run(speakers=["mc"], speakers_group="g") == [0, 2]
    assert run(near={"group": "g", "min": 0}) == [0, 2, 3]


def test_rows_of_a_line_share_the_last_window(spark):
    rows = [("a", "aa", "f", 1), ("b", "x", "f", 2), ("c", "x", "f", 2), ("d", "aa", "f", 3), ("e", "aa", "g", 1)]
    out = qa.window_counts(entries(spark, rows), {"ga": ("aa",)}, ["ga"], 1)
    assert {r["text"]: r["near_0"] for r in out.collect()} == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1}
    wide = qa.window_counts(entries(spark, rows), {"ga": ("aa",)}, ["ga"], 2)
    assert {r["text"]: r["near_0"] for r in wide.collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 1}


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_windows_over_pieces_of_a_file(spark, monkeypatch, chunk):
    import random

    rng = random.Random(chunk)
    rows = [(f"t{k}", rng.choice(["aa", "bb", "x", None]), rng.choice(["f", "f", "g", None]), rng.choice([None, *range(40)])) for k in range(160)]
    expected = {}
    for file in {f for _, _, f, _ in rows}:
        here = sorted((k for k, r in enumerate(rows) if r[2] == file), key=lambda k: (rows[k][3] is not None, rows[k][3] or 0, k))
        last = {rows[k][3]: p for p, k in enumerate(here)}
        for k in here:
            p = last[rows[k][3]]
            expected[k] = tuple(sum(rows[j][1] == g for j in here[max(0, p - 4) : p + 5]) for g in ("aa", "bb"))
    monkeypatch.setattr(qa, "CHUNK", chunk)
    out = qa.window_counts(entries(spark, rows), {"ga": ("aa",), "gb": ("bb",)}, ["ga", "gb"], 4)
    assert {r["seq"]: (r["near_0"], r["near_1"]) for r in out.collect()} == expected


def test_report(spark, tmp_path):
    profile = Profile({"game_name": "G", "language_id": "el"})
    e = entries(spark, [("a", "x", "f.rpy", 3), ("b" * 100, "x", "f.rpy", 4)])
    text, code = qa.report(qa.issues(e, progress(spark, {"b" * 100: "γ" * 95})), profile, 2, 1)
    assert code == 1 and "[MISSING]  spk=x  f.rpy:3" in text and "CLEAN" in text and "Hard issues:      1" in text and "G → el" in text
    text, code = qa.report(qa.issues(e.filter("seq > 0"), progress(spark, {"b" * 100: "γ" * 95})), profile, 1, 1)
    assert code == 0 and text.count("CLEAN") == 4
    many = qa.issues(e, progress(spark, {"a": "Q", "b" * 100: "Q" * 95}), QaRules.parse({"roman_check": False, "rules": [{"name": "n", "pattern": "Q", "category": 5}]}))
    text, _ = qa.report(many, profile, 2, 2)
    assert "CAT 5  (2 issues)" in text and "EN: " + "b" * 80 + "\n" in text and "TR: " + "Q" * 90 + "\n" in text


def test_missing_rules_file_warns(tmp_path):
    rules, warning = load_rules(Profile({"language_id": "x", "qa_rules_file": "none.json"}, str(tmp_path)))
    assert rules == QaRules() and "not found" in warning
    assert load_rules(Profile({"language_id": "x", "qa_rules_file": "none.json"}, str(tmp_path)), technical_only=True)[1] is None


def test_empty(spark):
    found = qa.issues(entries(spark, []), progress(spark, {}), QaRules.parse(RULES))
    assert found.count() == 0
    assert {tuple(r) for r in qa.by_category(found).collect()} == {(c, 0) for c in (1, 2, 3, 4)}
    assert tuple(qa.summary(found).first()) == (0, 0, 0, False)
