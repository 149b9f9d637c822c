import json

import pytest

from scriptloom.__main__ import main


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rpy").write_text('label x:\n    ada "Hi [n]."\n    ada "Hi [n]."\nscreen s:\n    text "Menu"\n', encoding="utf-8")
    (tmp_path / "src" / "b.rpy").write_text('bo "Third {b}one{/b}"\n', encoding="utf-8")
    profile = {"game_name": "G", "language_id": "el", "source_dir": "src", "strings_file": "out/strings.json", "progress_file": "tr.json", "api": {"provider": "echo", "batch_size": 1}}
    (tmp_path / "profile.json").write_text(json.dumps(profile))
    return tmp_path


def test_round_trip(spark, project, capsys):
    profile = str(project / "profile.json")
    assert main(["extract", "--profile", profile, "--screens"]) == 0
    assert "a.rpy: 3 strings" in capsys.readouterr().out
    strings = json.loads((project / "out" / "strings.json").read_text(encoding="utf-8"))
    assert [(s["text"], s["kind"]) for s in strings] == [("Hi [n].", "say"), ("Menu", "screen"), ("Third {b}one{/b}", "say")]
    (project / "tr.json").write_text('{"Menu": "MENOU", "other": "kept"}')
    assert main(["qa", "--profile", profile, "--technical-only"]) == 1
    assert "MISSING" in capsys.readouterr().out
    assert main(["translate", "--profile", profile, "--pause", "0"]) == 0
    assert "Total: 3 | Done: 2 | Todo: 2" in capsys.readouterr().out
    done = json.loads((project / "tr.json").read_text(encoding="utf-8"))
    assert list(done.items()) == [("Menu", "MENOU"), ("other", "kept"), ("Hi [n].", "HI [n]."), ("Third {b}one{/b}", "THIRD {b}ONE{/b}")]
    assert main(["translate", "--profile", profile, "--pause", "0"]) == 0
    assert "All strings already translated." in capsys.readouterr().out
    assert main(["qa", "--profile", profile, "--report", str(project / "r.txt")]) == 0
    assert "Hard issues:      0" in (project / "r.txt").read_text(encoding="utf-8")
    assert main(["build", "--profile", profile, "--out", str(project / "patch"), "--split-size", "2"]) == 0
    assert sorted(p.name for p in (project / "patch" / "tl" / "el").iterdir()) == ["00_el_filter.rpy", "01_el_dict.rpy", "02_el_dict.rpy", "02_el_strings.rpy"]


def test_arguments(spark, project, capsys):
    with pytest.raises(SystemExit):
        main(["extract"])
    assert main(["extract", "--src", str(project / "none"), "--out", str(project / "o.json")]) == 1
    assert main(["extract", "--src", str(project / "src"), "--out", str(project / "o.json"), "--no-dedupe"]) == 0
    # without screens mode a screen's text statement reads like a line said by "text"
    assert [s["speaker"] for s in json.loads((project / "o.json").read_text())] == ["ada", "ada", "text", "bo"]
