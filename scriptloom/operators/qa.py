"""Quality checks of translations: technical, declarative rules over a context window, phrasing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.order import numbered
from ..model import Profile, QaRule, QaRules

#: Section titles of the report.
TITLES = {
    1: "CAT 1 — Technical (missing / tag / variable)",
    2: "CAT 2 — Register Violations (speaker)",
    3: "CAT 3 — Register Violations (relationship)",
    4: "CAT 4 — Phrasing Flags (manual review)",
}


def with_translations(entries: DataFrame, progress: DataFrame) -> DataFrame:
    """Every entry with its translation or null."""
    return entries.join(progress.select("text", "tr"), "text", "left")


def missing(tr: Column) -> Column:
    return tr.isNull() | X.blank(tr)


#: Rows that one task counts over; the rows around each such piece are copied to it.
CHUNK = 1 << 16


def window_counts(rows: DataFrame, groups: dict[str, tuple[str, ...]], names: list[str], width: int) -> DataFrame:
    """Add ``near_<k>`` for the k-th named group: its speakers among the rows within ``width`` of the row in its file.

    Rows that share file and line use the window of the last of them. Rows are numbered
    once in the order of their files, which computes and writes them once; pieces of
    ``CHUNK`` numbers are counted, on numbers and speaker flags only, and a row within
    ``width`` of another piece is copied there.
    """
    if not names:
        return rows
    held = numbered(rows, ["file", "line", "seq"], "_at")
    members = [F.col("speaker").isin(*groups[n]) if groups.get(n) else F.lit(False) for n in names]
    slim = held.select("file", "line", "_at", *[F.when(m, 1).otherwise(0).alias(f"_g{k}") for k, m in enumerate(members)])
    piece = lambda at: F.floor(at / CHUNK)
    spread = slim.withColumn("_piece", F.explode(F.array_distinct(F.array(piece(F.col("_at") - width), piece(F.col("_at")), piece(F.col("_at") + width))) if width < CHUNK else F.sequence(piece(F.col("_at") - width), piece(F.col("_at") + width))))
    around = Window.partitionBy("_piece", "file").orderBy("_at").rowsBetween(-width, width)
    counted = spread.select("file", "line", "_at", "_piece", *[F.sum(f"_g{k}").over(around).alias(f"_c{k}") for k in range(len(names))])
    counted = counted.filter(F.col("_piece") == piece(F.col("_at")))
    counts = F.struct(*[F.col(f"_c{k}").alias(f"near_{k}") for k in range(len(names))])
    last = counted.groupBy(F.struct("file", "line").alias("_key")).agg(F.max_by(counts, "_at").alias("_near"))
    out = held.withColumn("_key", F.struct("file", "line")).join(last, "_key")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "_near.*")


def rule_holds(rule: QaRule, names: list[str]) -> Column:
    """Speaker, monologue, pattern and window predicates, cheapest first."""
    tests: list[Column] = []
    if rule.speakers is not None:
        tests.append(F.col("speaker").isin(*rule.speakers) if rule.speakers else F.lit(False))
    if rule.skip_monologue:
        tests.append(~X.monologue(F.col("text")))
    tests.append(X.matches(F.col("tr"), rule.pattern))
    if rule.near:
        count = F.col(f"near_{names.index(rule.near.group)}")
        tests.append(count >= rule.near.least)
        tests += [count >= F.col(f"near_{names.index(o)}") for o in rule.near.over]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return F.coalesce(out, F.lit(False))


def _issue(hit: Column, category: int, label: Column, ordinal: int, once: bool = False) -> Column:
    return F.when(hit, F.struct(F.lit(category).alias("category"), label.alias("label"), F.lit(ordinal).alias("check_ord"), F.lit(once).alias("once")))


def technical() -> list[Column]:
    tags, variables = X.lost(F.col("text"), F.col("tr"), X.TAG), X.lost(F.col("text"), F.col("tr"), X.VARIABLE)
    return [_issue(tags != "", 1, F.concat(F.lit("TAG:"), tags), 1), _issue(variables != "", 1, F.concat(F.lit("VAR:"), variables), 2)]


def phrasing(config: QaRules, keep: list[str], ordinal: int) -> list[Column]:
    words = X.latin_words(F.col("tr"), keep)
    out = []
    if config.roman:
        out.append(_issue(F.size(words) > 0, 4, F.concat(F.lit("roman:"), F.array_join(F.slice(words, 1, 3), ",")), ordinal))
    short = (F.length("text") > config.short_least) & (F.length("tr") < F.length("text") * F.lit(float(config.short_ratio)))
    return [*out, _issue(short, 4, F.lit("short?"), ordinal + 1)]


def issues(entries: DataFrame, progress: DataFrame, config: QaRules | None = None, keep: list[str] | None = None, technical_only: bool = False) -> DataFrame:
    """(category, label, speaker, file, line, text, tr, seq, check_ord): every issue of every entry."""
    config = config or QaRules()
    checks = technical()
    if not technical_only:
        near = [r.near for r in config.rules if r.near]
        names = sorted({n for x in near for n in (x.group, *x.over)})
        entries = window_counts(entries, config.groups, names, config.window)
        for k, rule in enumerate(config.rules):
            checks.append(_issue(rule_holds(rule, names), rule.category, F.lit(rule.name), 3 + k, rule.dedupe))
        checks += phrasing(config, keep or [], 3 + len(config.rules))
    rows = with_translations(entries, progress)
    absent = _issue(F.lit(True), 1, F.lit("MISSING"), 0)
    found = F.when(missing(F.col("tr")), F.array(absent)).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    out = rows.withColumn("i", F.explode(found)).select(
        "i.category", "i.label", "speaker", "file", "line", "text", F.coalesce("tr", F.lit("")).alias("tr"), "seq", "i.check_ord", F.col("i.once").alias("once")
    )
    if technical_only or not any(r.dedupe for r in config.rules):
        return out.drop("once")
    # one partial aggregation keeps the first entry of each (rule, text); an issue of another check is a group of its own
    rest = ("category", "label", "speaker", "file", "line", "tr")
    each = F.when(~F.col("once"), F.col("seq"))
    first = out.groupBy("check_ord", "text", each.alias("each")).agg(F.min(F.struct("seq", *rest)).alias("f"))
    return first.select("f.category", "f.label", "f.speaker", "f.file", "f.line", "text", "f.tr", "f.seq", "check_ord")


def by_category(found: DataFrame, technical_only: bool = False) -> DataFrame:
    """Issues of each category; 1 to 4 always appear."""
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    wanted = found.sparkSession.createDataFrame([(c,) for c in ([1] if technical_only else [1, 2, 3, 4])], "category int")
    return counts.join(wanted, "category", "full").select("category", F.coalesce("n", F.lit(0)).alias("n_issues"))


def summary(found: DataFrame) -> DataFrame:
    """One row: hard issues (not category 4), those to review, all, and whether the check fails."""
    hard, soft = F.count_if(F.col("category") != 4), F.count_if(F.col("category") == 4)
    return found.agg(hard.alias("hard"), soft.alias("review"), (hard + soft).alias("total"), (hard > 0).alias("fails"))


#: Order of the report's lines.
REPORT_ORDER = ["section", "seq", "check_ord", "k"]


def report_frame(found: DataFrame, profile: Profile, n_strings: int, n_translations: int, counts: dict[int, int]) -> DataFrame:
    """(section, seq, check_ord, k, value): the lines of the report (a fixed layout); issues stay where they are, three lines each."""
    bar = "=" * 72
    title = profile.data.get("language_name", profile.data.get("language_id", "?"))
    head = ["", "#" * 72, f"  TRANSLATION QUALITY REPORT — {profile.data.get('game_name', '?')} → {title}", f"  Strings: {n_strings} | Trans loaded: {n_translations}", "#" * 72]
    sections = [[] for _ in range(len(counts) + 2)]
    sections[0] = head
    place = {c: k for k, c in enumerate(sorted(counts), 1)}
    for c, k in place.items():
        sections[k] = ["", bar, f"  {TITLES.get(c, f'CAT {c}')}  ({counts[c]} issues)", bar, *([] if counts[c] else ["  CLEAN — no issues found."])]
    hard, review = sum(n for c, n in counts.items() if c != 4), counts.get(4, 0)
    sums = [f"  Cat {c}: {counts[c]:4d}  {'(review manually)' if c == 4 else '(must fix)'}" for c in sorted(counts)]
    sections[-1] = ["", bar, "  SUMMARY", bar, *sums, "  " + "-" * 25, f"  Hard issues:   {hard:4d}", f"  Total flagged: {hard + review:4d}", ""]
    fixed = [(n, -1, -1, k, x) for n, lines in enumerate(sections) for k, x in enumerate(lines)]
    schema = "section int, seq long, check_ord int, k int, value string"
    where = F.concat(F.lit("  ["), "label", F.lit("]  spk="), "speaker", F.lit("  "), "file", F.lit(":"), F.col("line").cast("string"))
    three = F.array(where, F.concat(F.lit("    EN: "), F.substring("text", 1, 80)), F.concat(F.lit("    TR: "), F.substring("tr", 1, 90)))
    section = F.coalesce(*[F.when(F.col("category") == c, k) for c, k in place.items()], F.lit(-1))
    issues_ = found.filter(F.col("category").isin(*counts)).select(section.alias("section"), F.col("seq").cast("long"), F.col("check_ord").cast("int"), F.posexplode(three).alias("k", "value"))
    return found.sparkSession.createDataFrame(fixed, schema).unionAll(issues_)


def report_counts(found: DataFrame, technical_only: bool = False) -> tuple[dict[int, int], int]:
    """Issues of each category, and the exit code."""
    counts = {r["category"]: r["n_issues"] for r in by_category(found, technical_only).collect()}
    if technical_only:
        counts = {1: counts.get(1, 0)}
    return counts, int(any(n for c, n in counts.items() if c != 4))


def report(found: DataFrame, profile: Profile, n_strings: int, n_translations: int, technical_only: bool = False) -> tuple[str, int]:
    """The report as one text, and the exit code."""
    lines, code = report_stream(found, profile, n_strings, n_translations, technical_only)
    return "\n".join(lines) + "\n", code


def report_stream(found: DataFrame, profile: Profile, n_strings: int, n_translations: int, technical_only: bool = False) -> tuple[Iterator[str], int]:
    """The lines of the report, one by one, and the exit code."""
    counts, code = report_counts(found, technical_only)
    frame = report_frame(found, profile, n_strings, n_translations, counts)
    return (r["value"] for r in frame.orderBy(*REPORT_ORDER).toLocalIterator()), code
