"""Exact duplicates: size, partial hash, whole hash, content, each only where the one before left a doubt.

Contents never move: sizes and hashes are grouped without them, and what is left
is picked from the catalogue by a semi-join, a broadcast one while the list of
survivors is of a checked size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorlake.functions import paths, signatures
from mirrorlake.operators.lineage import cut, small
from mirrorlake.options import ScanOptions


def eligible(files: DataFrame, o: ScanOptions) -> DataFrame:
    """Catalogue rows that the options admit: names, folders, sizes, roots."""
    test = paths.not_excluded("name", "parent", o.exclude_globs, o.exclude_dirs) & paths.size_in_range("size", o.min_size, o.max_size) & paths.allowed("path", o.roots)
    return files.filter(test)


def collapse_hardlinks(files: DataFrame) -> DataFrame:
    """One row for each file with several names: that of the least path. Shuffles linked rows only."""
    first = F.row_number().over(Window.partitionBy("dev", "inode").orderBy("path"))
    linked = files.filter("nlink > 1").withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    return files.filter("nlink <= 1 or nlink is null").unionByName(linked)


def unique_paths(files: DataFrame) -> DataFrame:
    """One row, that of the least id, for each path of a scan."""
    best = F.row_number().over(Window.partitionBy("scan_id", "path").orderBy("id"))
    return files.withColumn("_nth", best).filter("_nth = 1").drop("_nth")


def repeated(files: DataFrame, *by: str) -> DataFrame:
    """Rows with content whose key occurs more than once; null keys don't count."""
    keys = files.filter("size > 0").dropna(subset=list(by)).groupBy(*by).count().filter("count > 1").drop("count")
    return files.join(small(cut(keys)), list(by), "left_semi").filter("size > 0")


def size_candidates(files: DataFrame) -> DataFrame:
    return repeated(files, "size")


def _filled(files: DataFrame, name: str, made: Callable[[], Column]) -> DataFrame:
    known = F.col(name) if name in files.columns else F.lit(None).cast("string")
    return files.withColumn(name, F.coalesce(known, made()) if "content" in files.columns else known)


def with_quick(files: DataFrame) -> DataFrame:
    """``quick`` where it is missing, from ``content`` if that is there."""
    return _filled(files, "quick", lambda: signatures.quick_hash(F.col("content"), F.col("size")))


def with_md5(files: DataFrame) -> DataFrame:
    """``md5`` where it is missing, from ``content`` if that is there."""
    return _filled(files, "md5", lambda: signatures.full_md5(F.col("content")))


def quick_candidates(files: DataFrame) -> DataFrame:
    return repeated(with_quick(size_candidates(files)), "size", "quick")


def md5_groups(files: DataFrame) -> DataFrame:
    """(md5, size, least, id): a row for each file that has the same hash and size as another, and the least id of them."""
    rows = cut(with_md5(files.filter("size > 0")).select("id", "md5", "size").dropna())
    groups = rows.groupBy("md5", "size").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(groups, ["md5", "size"]).select("md5", "size", "least", "id")


def verified_clusters(files: DataFrame, verify: bool = True) -> DataFrame:
    """(signature, verified, size, least, id): a row for each file of a group of equal content, with the group's least id.

    With ``verify`` the files of one MD5 are parted by a 512-bit hash of their
    bytes; the first part, by least id, keeps the MD5 as signature, others add a
    number, which counts parts of one file too. Files without content are left out.
    """
    if not verify:
        return md5_groups(files).select(F.col("md5").alias("signature"), F.lit(False).alias("verified"), "size", "least", "id")
    rows = with_md5(files.filter("size > 0 and content is not null")).select("id", "md5", "size", signatures.strong_hash(F.col("content")).alias("strong"))
    return numbered(rows)


def numbered(hashed: DataFrame) -> DataFrame:
    """The clusters of (id, md5, size, strong), as :func:`verified_clusters` gives them; parts of an MD5 are numbered by their least id."""
    rows = cut(hashed.select("id", "md5", "size", "strong").dropna())
    parts = rows.groupBy("md5", "size", "strong").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("md5", "size").orderBy("least")) - 1  # one part, but for collisions
    signature = F.when(F.col("nth") == 0, F.col("md5")).otherwise(F.concat("md5", F.lit("#"), F.col("nth").cast("string")))
    parts = parts.withColumn("nth", nth).filter("n > 1").withColumn("signature", signature)
    return rows.join(parts, ["md5", "size", "strong"]).select("signature", F.lit(True).alias("verified"), "size", "least", "id")


def cascade(files: DataFrame, o: ScanOptions | None = None) -> DataFrame:
    """:func:`verified_clusters` of what size and partial hash leave; for contents that are dear to read."""
    o = o or ScanOptions()
    return verified_clusters(quick_candidates(files), o.verify_bytes)
