"""Folders that hold the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorlake.functions import names


def member_folders(members: DataFrame, files: DataFrame) -> DataFrame:
    return members.select("group_id", "file_id").join(files.select(F.col("id").alias("file_id"), "parent", "size"), "file_id")


def folder_pairs(members: DataFrame, files: DataFrame) -> DataFrame:
    """(a, b, shared_files, shared_bytes), a < b: pairs of equal files in unlike folders.

    Every pair of members counts, with the smaller's bytes. A group is first summed
    up as (folder, size, count), so that it joins itself by folders, not by files;
    members of a folder have few sizes, one in an exact group.
    """
    rows = member_folders(members, files).groupBy("group_id", "parent", "size").agg(F.count("*").alias("n"))
    a = rows.select("group_id", F.col("parent").alias("a"), F.col("size").alias("sa"), F.col("n").alias("na"))
    b = rows.select("group_id", F.col("parent").alias("b"), F.col("size").alias("sb"), F.col("n").alias("nb"))
    both = a.join(b, "group_id").filter("a < b").withColumn("n", F.col("na") * F.col("nb"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("shared_files"), F.sum(F.col("n") * F.least("sa", "sb")).alias("shared_bytes"))


def overlap(shared: Column, a_files: Column, b_files: Column) -> Column:
    """Percent of the smaller folder that is shared; an empty one counts as one file."""
    smaller = F.greatest(F.least(a_files, b_files), F.lit(1))
    return F.bround(F.least(shared / smaller, F.lit(1.0)) * 100).cast("int")


def folder_report(members: DataFrame, files: DataFrame, limit: int = 60, related: bool = True) -> DataFrame:
    """The pairs with most shared bytes, with folder totals, overlap and kinship, kin first.

    ``limit``, 300 at most, comes before kinship; ties go by name.
    """
    top = folder_pairs(members, files).orderBy(F.desc("shared_bytes"), "a", "b").limit(min(limit, 300))
    total = files.groupBy("parent").agg(F.count("*").alias("n"))
    side = lambda c: total.select(F.col("parent").alias(c), F.col("n").alias(c + "_files"))
    rows = top.join(side("a"), "a", "left").join(side("b"), "b", "left").fillna(0, ["a_files", "b_files"])
    rows = rows.withColumn("overlap", overlap(F.col("shared_files"), F.col("a_files"), F.col("b_files")))
    if related:
        rows = rows.withColumn("kin", names.kinship("a", "b")).select("*", "kin.related", "kin.why").drop("kin")
        return rows.orderBy(F.desc("related"), F.desc("shared_bytes"), "a", "b")
    return rows.orderBy(F.desc("shared_bytes"), "a", "b")


def browse(files: DataFrame, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(name, path, file_count, skipped): folders right below ``folder`` with the files in them at any depth, by name."""
    top = folder.rstrip("/") + "/"
    name = F.substring_index(F.substring("parent", len(top) + 1, 1 << 30), "/", 1)
    rows = files.filter(F.startswith("parent", F.lit(top))).select(name.alias("name"))
    out = rows.groupBy("name").agg(F.count("*").alias("file_count")).select("name", F.concat(F.lit(top), "name").alias("path"), "file_count", F.col("name").isin(*exclude).alias("skipped") if exclude else F.lit(False).alias("skipped"))
    return out.orderBy(F.lower("name"), "name")


def files_here(files: DataFrame, folder: str) -> DataFrame:
    """(file_count, bytes) of the files directly in a folder."""
    return files.filter(F.col("parent") == folder).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def newest_kept(members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, file_id, is_newest): the newest present member of each group is kept, the others selected."""
    rows = members.select("group_id", "file_id").join(files.filter("status = 'present'").select(F.col("id").alias("file_id"), "mtime"), "file_id")
    nth = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("mtime"), "file_id"))
    return rows.select("group_id", "file_id", (nth == 1).alias("is_newest"))
