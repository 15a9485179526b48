"""The corpus pipeline: documents to packed training sequences.

Each stage takes the documents that the one before has kept and, but for the last, returns documents with the same
columns. What a stage decides takes effect: rows go, or their texts are cleaned (n_chars, where there is one, follows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, language, neardup, packing, secrets
from quire.llm.common import stored, table
from quire.session import small_side

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_text(df: DataFrame, columns: list[str], cleaned: str) -> DataFrame:
    """The columns, with `cleaned` as text and its length as n_chars."""
    new = {"text": F.col(cleaned), "n_chars": F.length(cleaned).cast("long")}
    return df.select(*[F.when(F.col(cleaned).eqNullSafe(F.col("text")), F.col(c)).otherwise(new[c]).alias(c)
                       if c in new else F.col(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without a single letter, null texts included, go."""
    prototypes = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    named = docs.toDF(*[f"in_{c}" for c in docs.columns])  # no column of documents meets one of the result
    seen = language.identify(named, prototypes, named.columns, text="in_text")
    return seen.where(F.col("lang_pred") != language.UNKNOWN).select(*named.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, of rows that repeat it one.

    Documents without words are in no group and stay.
    """
    found = stored(neardup.near_duplicates(docs).select("doc_id", "text_hash", "first", "n_shingles"), "found")
    keys = [F.col("doc_id").alias("__of__"), F.col("text_hash").alias("__hash__")]
    here = F.col("doc_id").eqNullSafe(F.col("__of__")) & (F.xxhash64("text") == F.col("__hash__"))
    gone = stored(found.where(~F.col("first")).select(*keys).distinct(), "gone")
    kept = docs.join(small_side(gone), here, "left_anti")
    repeated = stored(found.where(F.col("first") & (F.col("n_shingles") > 0)).groupBy(*keys).count().where("count > 1")
                      .select("__of__", "__hash__"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, here, "left_anti").unionByName(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold a benchmark window are cut out; documents without a word left go."""
    slices = decontamination.window_slices(decontamination.benchmark_windows(table(spark, sf_dir, "benchmark")))
    cleaned = decontamination.remove_spans(docs, slices, cleaned="__cleaned__")
    return with_text(cleaned.where(F.col("__cleaned__").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
                                   | F.col("__cleaned__").eqNullSafe(F.col("text"))), docs.columns, "__cleaned__")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return with_text(secrets.redact(docs, made="__redacted__"), docs.columns, "__redacted__")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# No stage but the exact ones can be said in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
