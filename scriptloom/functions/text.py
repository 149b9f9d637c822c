"""Patterns and column functions: white space, markup tokens, literals.

Patterns are for Java: Unicode classes are switched on where white space counts,
line ends are LF only, and quoted strings are unrolled with possessive loops so
that long strings do not exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x1c-\x1f]"
INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
INSIDE_SINGLE = r"[^'\\]*+(?:\\.[^'\\]*+)*+"
QUOTED = f'"({INSIDE})"'
WORD = r"[\p{L}\p{N}_]"
NAME = rf"[a-zA-Z_]{WORD}*+"

SAY = rf"(?Ud)^(\s*)({NAME})\s+{QUOTED}\s*(?:\([^)]*\))?\s*\z"
NARRATOR = rf"(?Ud)^(\s*){QUOTED}\s*\z"
MENU = rf"(?Ud)^(\s+){QUOTED}(?:\s+if\s+[^:]+)?:\s*\z"
SHOW_TEXT = rf"(?Ud)^(\s*)show\s+text\s+{QUOTED}"
SCREEN_HEADER = rf"(?Ud)^screen\s+{WORD}+.*:\s*\z"
SCREEN_TEXT = rf"(?Ud)^\s*(?:text|textbutton|label|tooltip)\s+{QUOTED}"
PYTHON_HEADER = rf"(?Ud)^(?:init\s+(?:-?\p{{Nd}}+\s+)?)?python(?:\s+{WORD}+)?\s*:\s*\z"
PYTHON_LINE = r"(?U)^\$\s"
UI_MARK = rf"""(?Ud)_\(\s*(?:"{INSIDE}"|'{INSIDE_SINGLE}')\s*\)"""
UI_TEXT = rf"""(?Ud)_\(\s*(?:"({INSIDE})"|'({INSIDE_SINGLE})')\s*\)"""

#: Markup tokens that a translation must keep.
VARIABLE = r"\[[^\]]+\]"
TAG = r"\{[^}]+\}"
ESCAPE = r"""\\[n"'\\]"""
LATIN_WORD = r"[a-zA-Z]{4,}"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; '' without one."""
    return F.regexp_extract(text, pattern, group)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{WHITE}+", "")


def indent(text: Column) -> Column:
    """Leading white-space characters; a tab is one."""
    return F.length(text) - F.length(lstrip(text))


def blank(text: Column) -> Column:
    return matches(text, rf"(?U)^{WHITE}*\z")


def translatable(text: Column) -> Column:
    """Something alphanumeric is left without variables and tags."""
    return matches(F.regexp_replace(text, rf"{VARIABLE}|{TAG}", ""), r"[\p{L}\p{N}]")


def monologue(text: Column) -> Column:
    return text.startswith("(") & text.endswith(")")


def signature(text: Column) -> Column:
    """Variables, tags and escapes as sorted lists: equal exactly where the multisets are."""
    return F.struct(*[F.sort_array(find_all(text, p)).alias(n) for n, p in (("variables", VARIABLE), ("tags", TAG), ("escapes", ESCAPE))])


def lost(source: Column, translation: Column, pattern: str) -> Column:
    """Distinct tokens of the source that the translation lacks, sorted and joined; '' if none."""
    return F.array_join(F.sort_array(F.array_except(find_all(source, pattern), find_all(translation, pattern))), ",")


def latin_words(translation: Column, keep: list[str]) -> Column:
    """Words of four or more Latin letters that are not on the keep list, in order."""
    words = find_all(translation, LATIN_WORD)
    kept = sorted({k.lower() for k in keep})
    if not kept:
        return words
    return F.filter(words, lambda w: ~F.lower(w).isin(kept))


def _chain(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_CONTROL = (("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t"))


def dict_literal(text: Column) -> Column:
    """A u'...' literal; escapes already typed in the text stay escapes."""
    body = _chain(text, ("\\", "\\\\"), ("'", "\\'"), ("\\\\n", "\\n"), ("\\\\t", "\\t"), ('\\\\"', '\\"'), *_CONTROL)
    return F.concat(F.lit("u'"), body, F.lit("'"))


def new_literal(text: Column) -> Column:
    """A double-quoted literal for translations; escapes already typed in the text stay escapes."""
    body = _chain(text, ("\\", "\\\\"), ('"', '\\"'), ("\\\\n", "\\n"), ("\\\\t", "\\t"), ('\\\\\\"', '\\"'), *_CONTROL)
    return F.concat(F.lit('"'), body, F.lit('"'))


def decode_escapes(text: Column) -> Column:
    """One pass over backslash pairs: n and t become control characters, all else itself."""
    parts = find_all(text, r"(?d)\\.|[^\\]++|\\")
    pair = lambda x: F.when(x == "\\n", "\n").when(x == "\\t", "\t").when(x.startswith("\\") & (F.length(x) == 2), F.substring(x, 2, 1)).otherwise(x)
    return F.array_join(F.transform(parts, pair), "")


def old_literal(text: Column) -> Column:
    """A double-quoted literal of source text: decoded once, encoded once."""
    body = _chain(decode_escapes(text), ("\\", "\\\\"), ('"', '\\"'), *_CONTROL)
    return F.concat(F.lit('"'), body, F.lit('"'))


def identifier(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")


def quoted_literals(text: Column, least: int = 4) -> Column:
    """Double-quoted pieces of at least ``least`` characters."""
    return find_all(text, rf'"([^"]{{{least},}})"', 1)
