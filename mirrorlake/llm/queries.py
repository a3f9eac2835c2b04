"""The queries of this subpackage, by name, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorlake.llm import chat, gam, leaks, near, packing, pii, repeats, rules, secret_scan, toxicity


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_semi_crf(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii(_t(spark, d, "documents"))


def op2_quality_gam(spark: SparkSession, d: str) -> DataFrame:
    return gam.quality_keep(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op3_toxicity_chain(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic_documents(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op4_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.secrets(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"))


def op6_repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_passages(_t(spark, d, "documents"))


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.rules_keep(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op8_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_t(spark, d, "documents"))


def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


def op10_chat_format(spark: SparkSession, d: str) -> DataFrame:
    return chat.format_chats(_t(spark, d, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii_semi_crf, op2_quality_gam, op3_toxicity_chain, op4_secret_scan, op5_packing, op6_repeated_passages, op7_quality_rules, op8_near_dedup, op9_decontamination, op10_chat_format)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": chat.SQL}
