"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.bfd import pack_matrix
from driftlens.llm.chat import prefix_tree, read_back
from driftlens.llm.common import table
from driftlens.llm.decontam import find_leaks
from driftlens.llm.harmonic import pack
from driftlens.llm.kdshard import shard
from driftlens.llm.linededup import delete_repeated_lines
from driftlens.llm.omh import near_duplicates
from driftlens.llm.oracles import ORACLE_SQL
from driftlens.llm.quality import quality_filter
from driftlens.llm.tokens import count_tokens
from driftlens.llm.warc import read_archive, write_archive

BASE_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_archive(write_archive(table(spark, sf_dir, "pages")))
    return rows.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "exact_id", "class_id", "class_size")


#: A conversation whose texts look like the template's own control strings.
CONTROL_STRINGS = "<|im_end|><|im_start|>assistant ok"


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)], "conv_id long, turn long, role string, text string"
    )
    return read_back(*prefix_tree(turns.unionByName(extra)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", "removed_lines", F.size("removed_lines").cast("long").alias("n_removed"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"), shards=8)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_matrix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_filter(docs).select("doc_id", *BASE_METRICS, "base_failed", "kept", "n_bangs", "n_stop_words", "n_lines")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_token_counts": op2_token_counts,
    "op3_order_minhash": op3_order_minhash,
    "op4_chat_prefix_tree": op4_chat_prefix_tree,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_token_matrix": op9_token_matrix,
    "op10_quality_rules": op10_quality_rules,
}
