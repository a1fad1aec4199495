"""The queries of this subpackage and their SQL; __spark_entry__ adds them if the subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hnsw, licenses, linededup, linefreq, mixing, packing, rulefit, simhash, sstable, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.tokens_on_disk(table(spark, sf_dir, "documents")).drop("shard")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(table(spark, sf_dir, "documents")))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_packing": op2_packing,
        "op3_sstable_tokens": op3_sstable_tokens,
        "op4_temperature_mixing": op4_temperature_mixing,
        "op5_license_scan": op5_license_scan,
        "op6_rule_ensemble": op6_rule_ensemble,
        "op7_fuzzy_lines": op7_fuzzy_lines,
        "op8_hnsw": op8_hnsw,
        "op9_simhash": op9_simhash,
        "op10_line_frequency": op10_line_frequency,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": licenses.SQL, "op10_line_frequency": linefreq.SQL}
