"""The registered queries of this subpackage: thin, over whole tables, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, table
from .fuzzy_lines import without_repeated_lines
from .metric_join import near_vectors
from .minhash import near_duplicates
from .mixing import mixed, word_count
from .mixing import oracle_sql as mixing_sql
from .packing import best_fit_packing, tokenized_pieces
from .quality_rules import quality_rules
from .substring_dedup import digest_rows, without_repeats
from .token_counts import token_counts
from .toxicity import toxicity
from .zip_warc import read_packages, write_packages


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, which lines went, who keeps them, and a digest of what is left."""
    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "kept_in", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_packages(spark, write_packages(table(spark, sf_dir, "pages"), shared_dir(spark)))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), word_count(F.col("text")))


def op8_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(tokenized_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048), 2048)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(without_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_metric_join": op1_metric_join,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_zip_warc": op5_zip_warc,
    "op6_bagminhash": op6_bagminhash,
    "op7_source_mixing": op7_source_mixing,
    "op8_bigru_toxicity": op8_bigru_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op7_source_mixing": mixing_sql(),
}
