"""The document pipeline: quality rules, line dedup, near dedup, decontamination, packing.

Every stage takes what the one before it kept, and all but the last return the columns of
``documents``; further columns, whatever their names, are carried. Empty tables give empty
tables. What each stage does with nulls, empty and very long texts, ties and repeated rows is
in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import decontaminate, linededup, minhash, packing, quality, tokens
from scriptloom.llm.common import materialise, shared_dir
from scriptloom.shipping import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy does not reject.

    Rows are judged one by one, repeated ones too, whatever their id; null, empty and short texts go (fewer than 50 words), and
    so do those of more than 1,000,000 words (rule too_many_words of the policy); all others are judged whole.
    """
    return quality.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; documents left without a word go.

    A null or empty text has no lines and stays as it is. Of equal windows the first by (doc_id, line) stays, null ids first;
    rows of one id are one document in the order of their text hashes, and rows equal in both keep the same lines. n_chars
    follows the new text.
    """
    count = "n_removed"
    while count.lower() in {c.lower() for c in docs.columns}:
        count = f"_{count}"
    out = linededup.dedup_lines(docs, count)
    left = (F.col(count) == 0) | F.col("text").rlike(linededup.WORD)
    return out.filter(left).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows count by (doc_id, text): of rows equal in both one stays, another text under the same id is another document, and of
    equal ids the smaller row hash goes first. Null and wordless texts link with nothing; rows with a null id all stay.
    """
    ship_package(spark)
    return minhash.keep_one(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no stretch of a benchmark item.

    Rows are judged one by one, whatever their id; null and empty texts hold nothing and stay, as all do for an empty benchmark.
    """
    ship_package(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens, as (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null and empty texts are their end id alone; null ids and repeated rows are packed like any other; texts longer than a
    sequence are cut; other columns are left out.
    """
    ship_package(spark)
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Stages 4 and 5 (q-gram filtering with alignment, tokenisation) have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
