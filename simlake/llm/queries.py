"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, decontam, licences, line_dedup, matroska, maxent, packing, preferences, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.offending_sentences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_matches(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.stale_reply_pairs(_table(spark, sf_dir, "conversations")))


def op4_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.packets(matroska.subtitle_files(_table(spark, sf_dir, "documents")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op6_benchmark_decontamination, op7_toxicity, op1_line_dedup, op2_preference_formatting, op4_matroska_packets, op3_token_counts, op5_packing, op8_licence_scan, op9_lm_scoring, op10_minhash_near_dedup)}
ORACLES: dict[str, str] = {"op2_preference_formatting": preferences.ORACLE}
