import ast

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptloom.functions import text as X
from scriptloom.model import Profile
from scriptloom.operators import patch, runtime
from scriptloom.sources.scripts import write_rendered

PROFILE = Profile({"game_name": "G", "language_id": "pt-br", "language_name": "Portuguese"})


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "value"), [("plain", "plain"), ("it's", "it's"), ("a\\nb", "a\nb"), ("a\nb\tc\r\nd\re", "a\nb\tc\nd\ne"), ('say \\"x\\"', 'say "x"'), ('"', '"'), ("[v] {b}", "[v] {b}")])
def test_dict_literal(spark, text, value):
    assert ast.literal_eval(one(spark, X.dict_literal, text)) == value


@pytest.mark.parametrize(("text", "value"), [("plain", "plain"), ('say \\"x\\"', 'say "x"'), ('"', '"'), ("a\\nb", "a\nb"), ("C:\\dir", "C:\\dir"), ("a\nb\t", "a\nb\t")])
def test_new_literal(spark, text, value):
    assert ast.literal_eval(one(spark, X.new_literal, text)) == value


@pytest.mark.parametrize(("text", "value"), [("a\\nb", "a\nb"), ("\\\\n", "\\n"), ("\\\\\\n", "\\\n"), ('\\"q\\"', '"q"'), ("\\q", "q"), ("end\\", "end\\"), ("", "")])
def test_old_literal(spark, text, value):
    assert ast.literal_eval(one(spark, X.old_literal, text)) == value
    assert one(spark, X.decode_escapes, text) == value


def test_identifier(spark):
    assert one(spark, X.identifier, "pt-br é.x") == "pt_br_é_x" == patch.identifier("pt-br é.x")


def progress(spark, n=5):
    return spark.createDataFrame([(f"t{k}", f"T{k}", k) for k in range(n)], "text string, tr string, pos long")


def entries(spark):
    rows = [("t1", "screen", 9), ("t1", "say", 2), ("t3", "ui", 4), ("t4", "say", 1), ("none", "ui", 3)]
    return spark.createDataFrame(rows, "text string, kind string, seq long")


def test_routing(spark):
    routed = patch.route_strings(progress(spark), entries(spark))
    assert [r["text"] for r in routed.orderBy("first").collect()] == ["t3", "t1"]
    assert {r["text"] for r in patch.route_dictionary(progress(spark), entries(spark)).collect()} == {"t0", "t2", "t4"}
    assert patch.route_dictionary(progress(spark), None).count() == 5


def test_files(spark, tmp_path):
    names = write_rendered(patch.build(progress(spark), PROFILE, entries(spark), size=2), str(tmp_path))
    assert [n.rsplit("/", 1)[1] for n in names] == ["00_pt_br_filter.rpy", "01_pt_br_dict.rpy", "02_pt_br_dict.rpy", "02_pt_br_strings.rpy"]
    first = open(names[1], encoding="utf-8").read()
    assert first.splitlines() == [
        "# Portuguese translation dictionary — auto-generated (part 1/2)", "# DO NOT EDIT BY HAND", "", "init 0 python:", "    _pt_br_translations.update({",
        "        u't0': u'T0',", "        u't2': u'T2',", "    })",
    ]
    strings = open(names[3], encoding="utf-8").read()
    assert strings.splitlines()[3:] == ["translate pt-br strings:", "", '    old "t3"', '    new "T3"', "", '    old "t1"', '    new "T1"']


def test_no_translations_gives_one_empty_dictionary(spark):
    built = patch.dictionary_rows(progress(spark, 0), PROFILE, 10).orderBy("ord").collect()
    assert {r["path"] for r in built} == {"01_pt_br_dict.rpy"} and "part" not in built[0]["line"] and built[-1]["line"] == "    })"


class Box:
    def __init__(self, **k):
        self.__dict__.update(k)


def python_of(source):
    """The statements of the python blocks of generated source."""
    out, on = [], False
    for line in source.splitlines():
        if line.startswith("init "):
            on = True
        elif line and not line.startswith((" ", "#")):
            on = False
        elif on and not line.startswith("#"):
            out.append(line[4:])
    return "\n".join(out)


def run(profile, earlier=None, styles=None):
    shown = []
    renpy = Box(game=Box(preferences=Box(language=None)), notify=shown.append, Keymap=lambda **k: k)
    renpy.change_language = lambda lang, force=False: setattr(renpy.game.preferences, "language", lang)
    config = Box(say_menu_text_filter=earlier, keymap={}, underlay=[], start_callbacks=[], after_load_callbacks=[], font_replacement_map={})
    scope = {"renpy": renpy, "config": config, "persistent": Box(_pt_br_auto_set=False), "style": Box(**(styles or {"default": Box(), "notify": Box()}))}
    exec(python_of(patch.filter_source(profile)), scope)
    scope["_pt_br_translations"]["hi"] = "oi"
    return scope, renpy, config


def test_fonts_survive_missing_styles():
    """A style that has no font keeps its size, and one that is missing stops nothing."""
    class Stubborn(Box):
        def __setattr__(self, key, value):
            if key == "font":
                raise AttributeError(key)
            super().__setattr__(key, value)

    font = {"regular": "R.ttf", "size_scale": 2, "base_sizes": {"notify": 10, "gone": 3}, "styles": ["gone", "notify", "default"]}
    profile = Profile({**PROFILE.data, "font": font})
    scope, renpy, config = run(profile, styles={"default": Box(), "notify": Stubborn()})
    renpy.change_language("pt-br")
    assert scope["style"].notify.size == 20 and scope["style"].default.font == "R.ttf"


def test_filter_runs():
    scope, renpy, config = run(PROFILE, lambda t: None if t == "oi" else t + "!")
    show = config.say_menu_text_filter
    assert show("hi") == "hi!" and show(None) is None
    config.keymap and scope["_pt_br_toggle"]()
    assert renpy.game.preferences.language == "pt-br"
    assert show("hi") == "oi" and show("no") == "no!"
    assert (scope["_pt_br_filter_hits"], scope["_pt_br_last_miss"]) == ([1], ["no"])
    scope["_pt_br_install_filter"]()
    assert config.say_menu_text_filter is show


def test_optional_blocks():
    font = {"regular": "R.ttf", "replace_fonts": ["a", "b", "c", "d"], "size_scale": 0.5, "base_sizes": {"notify": 31}, "styles": ["default", "notify"]}
    scope, renpy, config = run(Profile({**PROFILE.data, "auto_set_language": True, "font": font}))
    scope["_pt_br_autostart"]()
    assert renpy.game.preferences.language == "pt-br" and scope["style"].notify.size == 15 and scope["style"].default.font == "R.ttf"
    assert config.font_replacement_map["d", True, True] == ("R.ttf", False, False) and len(config.font_replacement_map) == 16
    plain = patch.filter_source(PROFILE)
    assert "autostart" not in plain and "FONT" not in plain and "translate pt-br python:\n    pass" in plain and '"K_F11"' in plain


def test_runtime(spark):
    rows = spark.createDataFrame([("t0", 0), ("x", 1), ("t1", 2), ("y", 3)], "text string, seq long")
    assert [r["shown"] for r in runtime.lookup(rows, progress(spark)).orderBy("seq").collect()] == ["T0", "x", "T1", "y"]
    assert [r["shown"] for r in runtime.lookup(rows, progress(spark), active=False).orderBy("seq").collect()] == ["t0", "x", "t1", "y"]
    assert tuple(runtime.counters(rows, progress(spark)).first()) == (4, 2, "y")
    lists = spark.createDataFrame([(1, ["t0", "z", "t0"], 2), (2, [], 0), (3, None, 0)], "k int, said array<string>, before int")
    assert {r["k"]: r["said"] for r in runtime.translate_arrays(lists, progress(spark), "said").collect()} == {1: ["T0", "z", "T0"], 2: [], 3: None}
    assert {r["k"]: r["said"] for r in runtime.translate_arrays(lists, progress(spark), "said", "before").collect()}[1] == ["t0", "z", "T0"]
    same = spark.createDataFrame([(1, ["t0"]), (1, ["t1", None]), (None, ["t2"]), (None, ["t2"]), (None, None)], "k int, said array<string>")
    found = runtime.translate_arrays(same, progress(spark), "said").collect()
    assert sorted(map(str, found)) == sorted(map(str, [Row(k=1, said=["T0"]), Row(k=1, said=["T1", None]), *[Row(k=None, said=["T2"])] * 2, Row(k=None, said=None)]))
    assert runtime.missing_functions(["a", "b"], {"b"}) == ["a"]
