"""Registered queries of the corpus operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerlake.llm import op1_backoff, op2_substring, op3_chat, op4_templates, op5_tokens, op6_pages, op7_pieces, op8_minhash, op9_suffix, op10_rules, op11_prefixes, op12_codes, op13_personal, oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_backoff.query(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_substring.query(table(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_chat.query(table(spark, sf_dir, "conversations"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_templates.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_tokens.query(table(spark, sf_dir, "documents"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pages.query(table(spark, sf_dir, "pages"))


def op7_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pieces.query(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_minhash.query(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_suffix.query(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_rules.query(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_prefixes.query(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_codes.query(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_personal.query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_backoff_scores, op2_substring_dedup, op3_chat_perspectives, op4_benchmark_leaks, op5_token_counts, op6_page_text, op7_piece_nbest, op8_minhash_dedup, op9_suffix_dedup, op10_quality_rules,
                                   op11_prefix_trie, op12_vector_codes, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
