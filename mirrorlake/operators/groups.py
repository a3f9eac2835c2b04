"""Groups and their members, as tables.

A group's id comes from its least member, so that numbering needs no global
order: twice that id for an exact group, one more for a near one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_COLUMNS = ("id", "scan_id", "kind", "signature", "similarity", "verified", "file_count", "total_bytes", "wasted_bytes", "max_size", "folder_span", "label")


def group_id(least: Column, kind: str) -> Column:
    return least * 2 + (1 if kind == "near" else 0)


def exact_members(clusters: DataFrame) -> DataFrame:
    """(group_id, file_id, similarity, signature, verified): 100 where proven, else 99."""
    gid = group_id(F.col("least"), "exact").alias("group_id")
    sim = F.when(F.col("verified"), 100.0).otherwise(99.0).alias("similarity")
    return clusters.select(gid, F.col("id").alias("file_id"), sim, "signature", "verified")


def group_rows(members: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Group rows over members (group_id, file_id, similarity, signature, verified); two found files at least.

    An exact group's similarity is its members'. The label is the name of the
    least id.
    """
    near = kind == "near"
    rows = members.join(files.select(F.col("id").alias("file_id"), "scan_id", "size", "parent", "name"), "file_id")
    stats = rows.groupBy("group_id").agg(
        F.min("scan_id").alias("scan_id"), F.min("signature").alias("signature"), F.min("similarity").alias("similarity"), F.bool_and("verified").alias("verified"),
        F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"), (F.sum("size") - F.max("size")).alias("wasted_bytes"), F.max("size").alias("max_size"),
        F.count_distinct("parent").alias("folder_span"), F.min_by("name", "file_id").alias("label"),
        F.bround((F.sum("similarity") - 100) / F.greatest(F.count("*") - 1, F.lit(1)), 1).alias("mean"),
    )
    value = F.col("mean") if near else F.col("similarity")
    out = stats.filter("file_count > 1").withColumns({"kind": F.lit(kind), "similarity": value})
    return out.withColumnRenamed("group_id", "id").select(*GROUP_COLUMNS)


def exact_groups(files: DataFrame, clusters: DataFrame) -> DataFrame:
    return group_rows(exact_members(clusters), files, "exact")
