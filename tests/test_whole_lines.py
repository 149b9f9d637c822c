"""The script queries over whole lines, against brute force, and whole made-up translations."""

import random
import re

import pytest

from scriptloom.model import NON_SPEAKERS

Q = r'"((?:[^"\\]|\\.)*)"'
WORDS = ["Tea", "[name]", "{b}loud{/b}", "it's", "(aside)", 'say "no"', "back\\slash", "if so:", "_('x')", "π"]


def documents():
    """(doc_id, source, text): long lines, many of them equal in their first 60 characters only."""
    rng = random.Random(4)
    heads = [("same beginning " * 5)[:60 + k] for k in range(0, 9, 3)]
    out = []
    for d in range(12):
        lines = [rng.choice(heads) + " ".join(rng.choices(WORDS, k=rng.randrange(30))) for _ in range(40)] + ["", "short", "[only]"]
        rng.shuffle(lines)
        out.append((d, f"s{d % 2}", rng.choice(["\n", "\r\n"]).join(lines)))
    return [*out, (90, "s0", None), (91, "s2", "")]


def dressed(docs):
    """(file, line, raw) of every document line as a script statement."""
    files = {}
    for d, source, text in sorted(docs):
        if text is not None:
            files.setdefault(source, []).extend(re.split(r"\r\n|\r|\n", text))
    for file, texts in files.items():
        for n, raw in enumerate(texts, 1):
            t, u = (raw.replace("\\", "\\\\").replace(q, "\\" + q) for q in "\"'")
            k, deep = n // 13, lambda m, k=n // 13: "    " * (k % m)
            yield file, n, [
                f'    hero "{t}"', f'    "{t}"', f'    "{t}" if ok:', f'    show text "{t}"', f'    $ x = "{t}"', deep(3) + "python:",
                f"{deep(4)}y = _('{u}') + _(\"{t}\")" if k % 3 == 0 else f'{deep(4)}y = _("{t}") + _("ok{n}")', f'# _("{t}")', f"{deep(2)}screen s{n}:", f'{deep(3)}text "{t}"',
                f'        textbutton _("[x]") action "{t}"', f'{deep(2)}label "{t}"', f'extend "{t}"' if k % 2 else "",
            ][n % 13]


def scanned(rows, screens):
    """Rows as (file, line, in_python, in_screen, screen_header) and entries as (text, speaker, file, line, kind), line by line."""
    flags, entries, at, python, screen = [], [], None, None, None
    ok = lambda t: t.strip() and any(c.isalnum() for c in re.sub(r"\[[^\]]+\]|\{[^}]+\}", "", t))
    for file, n, raw in rows:
        if file != at:
            at, python, screen = file, None, None
        body = raw.lstrip()
        indent = len(raw) - len(body)
        if screens and not body.startswith("#"):
            entries += [(m[2], "_ui", file, n, "ui") for m in re.finditer(r"""_\(\s*(["'])((?:(?!\1)[^\\]|\\.)*)\1\s*\)""", raw) if ok(m[2])]
        python = python if python is not None and (not body or indent > python) else None
        inside = python is not None
        header = bool(re.match(r"(init\s+(-?\d+\s+)?)?python(\s+\w+)?\s*:\s*\Z", body))
        if header and not inside:
            python = indent
        hidden = inside or header or bool(re.match(r"\$\s", body)) or body.startswith("#")
        in_screen = opens = False
        if screens and not hidden:
            screen = screen if screen is not None and (not body or indent > screen) else None
            in_screen = screen is not None
            opens = bool(re.match(r"screen\s+\w+.*:\s*\Z", body))
            screen = indent if opens and not in_screen else screen
        flags.append((file, n, inside, in_screen, opens))
        if hidden or opens:
            continue
        if in_screen:
            m = re.match(rf"\s*(?:text|textbutton|label|tooltip)\s+{Q}", raw)
            entries += [(m[1], "_screen", file, n, "screen")] if m and ok(m[1]) else []
            continue
        show, said = re.match(rf"\s*show\s+text\s+{Q}", raw), re.match(rf"\s*([a-zA-Z_]\w*)\s+{Q}\s*(?:\([^)]*\))?\s*\Z", raw)
        menu, narrator = re.match(rf"\s+{Q}(?:\s+if\s+[^:]+)?:\s*\Z", raw), re.match(rf"\s+{Q}\s*\Z", raw)
        said = said if said and said[1] not in NON_SPEAKERS else None
        found = (show[1], "_text", "text") if show else (said[2], said[1], "say") if said else (menu[1], "_menu", "menu") if menu else (narrator[1], "narrator", "narrator") if narrator else None
        if found and found[0].strip():
            entries.append((found[0], found[1], file, n, found[2]))
    return flags, entries


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(documents(), "doc_id long, source string, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, list(dressed(documents()))


def test_whole_lines_equal_brute_force(spark, given):
    from scriptloom.plans import adapters
    from scriptloom.plans.queries import QUERIES

    folder, rows = given
    got = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    assert sorted(tuple(r) for r in adapters.script(spark, folder).collect()) == rows
    flags, plain = scanned(rows, False)
    shown, full = scanned(rows, True)
    assert any(len(e[0]) > 60 for e in plain) and len({e[0] for e in plain}) > len({e[0][:60] for e in plain})

    body = [(f, n, raw, raw.lstrip()) for f, n, raw in rows]
    python = [bool(re.match(r"(init\s+(-?\d+\s+)?)?python(\s+\w+)?\s*:\s*\Z", b)) for *_, b in body]
    assert got("line_layout") == [(f, n, len(raw) - len(b), not b, p, bool(re.match(r"\$\s", b)), b.startswith("#")) for (f, n, raw, b), p in zip(body, python, strict=True)]
    assert got("block_mask_python") == [x[:2] for x in flags if x[2]]
    assert got("block_mask_screen") == shown
    assert got("parse_statements") == sorted(plain) and got("parse_screens") == sorted(full)
    assert got("extract_all") == sorted((*e, k) for k, e in enumerate(plain))
    first = {}
    for k, e in enumerate(full):
        first.setdefault(e[0], (*e, k))
    assert got("extract_unique") == sorted(first.values())
    assert got("per_file_summary") == [(f, sum(e[2] == f for e in plain)) for f in sorted({r[0] for r in rows})]
    assert got("extract_totals") == [(len(plain), len({e[0] for e in plain}))]
    assert got("subsystem_literals") == sorted((f, n, t) for f, n, raw in rows for t in re.findall(r'"([^"]{4,})"', raw))


def test_translations_are_whole(spark, tmp_path):
    from scriptloom.plans import adapters

    props = "x" * 3000 + "[end]"
    spark.sql(f"SELECT 15L AS event_id, timestamp'2024-01-01' AS ts, 1L AS user_id, 'click' AS event_type, '{props}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in adapters.event_progress(spark, str(tmp_path)).collect()] == [(f"click [u1] {props}", f"CLICK [u1] {props}", 15)]
