"""Rule bitmask ledger for document quality (native column expressions only).

``ledger`` evaluates every rule once per document and stores one failure bit per
rule beside the measurements. Policies are versioned bit masks, so applying one
or asking what a rule contributes never looks at the text again.

Defined results: a null or empty text has no words and fails ``too_few_words``;
null ids and clashing extra columns are carried along (an input column with the
name of a measurement is replaced); repeated rows are judged one by one; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, let

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements, integer arithmetic) holds."""

    bit: int
    name: str
    fails: str


#: Bits never change their meaning; new rules take new bits.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule(5, "shouting", "10 * n_upper > 4 * word_chars"),
    Rule(6, "too_many_words", "n_words > 1000000"),
)

#: Policy version -> rules whose failure rejects a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_per_word", "duplicate_lines", "word_length", "shouting", "too_many_words"),
}


def policy_mask(version: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window whose content occurs twice or more in the text."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(hashed), covered))


def _without(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(text: Column) -> Column:
    """A struct of all measurements of one text."""
    clean = F.coalesce(text, F.lit(""))

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    def by_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        let(words_of(clean), by_words).alias("w"),
        let(F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), by_lines).alias("l"),
        _without(clean, SYMBOLS).alias("n_symbols"),
        _without(clean, UPPER).alias("n_upper"),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus one column for each measurement and ``fail_bits`` (bit set: the rule fails)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "fail_bits", "_m")]
    out = docs.withColumn("_m", measure(F.col(text_col))).select(
        *kept,
        F.col("_m.w.n_words").alias("n_words"),
        F.col("_m.w.word_chars").alias("word_chars"),
        F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("_m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("_m.l.n_lines").alias("n_lines"),
        F.col("_m.n_upper").alias("n_upper"),
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    return out.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: str, out: str = "kept") -> DataFrame:
    """Add the verdict of a policy to a ledger."""
    return book.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablation(book: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept if it were dropped).

    One aggregation to at most 2^rules rows of distinct bit patterns, then bitwise sums over those.
    """
    mask = policy_mask(version)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("mask")) for r in RULES if (mask >> r.bit) & 1])
    one = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.mask")
    return one.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("mask"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_documents"),
    )


def verdicts(docs: DataFrame, version: str = "v1") -> DataFrame:
    """One row per document: the base measurements, ``base_failed`` and ``kept``."""
    book = apply_policy(apply_policy(ledger(docs.select("doc_id", "text")), "base", "_base"), version, "_kept")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("_base")).alias("base_failed"),
        (F.col("_base") & F.col("_kept")).alias("kept"),
    )


def keep_documents(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_text"))
    book = apply_policy(apply_policy(ledger(packed, "_text"), "base", "_base"), version, "_kept")
    return book.filter(F.col("_base") & F.col("_kept")).select(*[F.col("_row").getField(c).alias(c) for c in columns])
