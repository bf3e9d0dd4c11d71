"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import SPACE, fresh, materialize, table
from driftlens.llm.decontam import without_leaks
from driftlens.llm.harmonic import pack
from driftlens.llm.linededup import delete_repeated_lines
from driftlens.llm.omh import one_of_each
from driftlens.llm.quality import quality_filter

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; rows that repeat are judged alike.

    Own columns that are called as a metric stay as they were.
    """
    clash = {c: fresh(docs, f"own_{c}") for c in docs.columns if c != "text"}
    renamed = docs.withColumnsRenamed(clash)
    back = [F.col(clash.get(c, c)).alias(c) for c in docs.columns]
    return quality_filter(renamed).filter("kept").select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which nothing but white space is left goes with them.

    Documents that lose nothing stay as they are, null and empty texts too.
    """
    gone = fresh(docs, "removed_lines")
    rows = delete_repeated_lines(docs, removed=gone)
    cleaned = rows.filter((F.size(gone) == 0) | (F.length(F.regexp_replace("text", SPACE, "")) > 0))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n_chars)
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id (null ids last), then text hash.

    Rows that share id and text are one document; texts without a word (null, empty) stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go; null and empty texts contain none."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences; a null or empty text is its end id alone, repeated rows are packed each."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str, counts: dict[str, int] | None = None) -> DataFrame:
    """All stages over documents, each written and read again before the next one.

    counts, if given, takes the number of rows that each stage but the last has left.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if counts is not None:
            counts[name] = docs.count()
    return STAGES[-1][1](spark, docs, sf_dir)


#: Packing by tokens, near-duplicate classes and repeated runs are beyond SQL.
ORACLE_SQL = None
