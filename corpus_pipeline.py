"""A corpus from documents to training windows, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mirrorlake.llm import leaks, near, packing, rules, secret_scan
from mirrorlake.operators.lineage import cut, remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees over their statistics reject go."""
    return rules.drop_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays."""
    return near.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return secret_scan.redact(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training windows."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", windows)]
#: Trained models, an approximate join and dynamic programming are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote goes once the next has read it; the result is a checkpoint,
    which Spark's cleaner removes when nothing refers to it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            if name == STAGES[-1][0]:
                return cut(out)
            out.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
            if before:
                remove(spark, f"{at}/{before}")
            before = name
    finally:
        remove(spark, at)
