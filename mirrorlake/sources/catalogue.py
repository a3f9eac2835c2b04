"""Tables of texts seen as a tree of files, so that scans can run over any corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.functions import paths

FOLDERS = ("Photos", "photo", "downloads", "backup", "Video", "Videos", "Bilder", "Pics", "projects", "archive")
EPOCH = 1704067200


def _named(rows: DataFrame, parent: Column, name: Column, scan_id: int) -> DataFrame:
    """A catalogue over (id, content): sizes in bytes, a minute between files, every 50th sharing its inode with the next."""
    i = F.col("id")
    rows = rows.withColumns({"parent": parent, "name": name, "size": F.octet_length("content").cast("long")})
    return rows.select(
        "id", F.lit(scan_id).cast("long").alias("scan_id"), F.concat_ws("/", "parent", "name").alias("path"), "parent", "name", paths.extension("name").alias("ext"), "size",
        (i * 60 + EPOCH).cast("double").alias("mtime"), F.lit(1).cast("long").alias("dev"), F.when(i % 50 == 0, i + 1).otherwise(i).alias("inode"),
        F.when((i % 50).isin(0, 1), 2).otherwise(1).cast("long").alias("nlink"), F.md5("content").alias("md5"), "content",
        F.when(i % 17 == 0, "deleted").when(i % 19 == 0, "quarantined").otherwise("present").alias("status"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` below /corpus, a folder for each source and language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"), "lang", "source")
    k = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), F.coalesce(k % len(FOLDERS), F.lit(0)) + 1)
    parent = F.concat_ws("/", F.lit("/corpus"), folder, "lang")
    mark = F.when(F.col("id") % 3 == 1, " copy").when(F.col("id") % 3 == 2, " (1)").otherwise("")
    return _named(d, parent, F.concat(F.lit("report "), F.col("id").cast("string"), mark, F.lit(".txt")), 1)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` below /web, a folder for each host."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.encode("html", "utf-8").alias("content"), "url")
    return _named(d, F.concat(F.lit("/web/"), F.regexp_extract("url", "^https?://([^/?#]+)", 1)), F.concat(F.lit("page "), F.col("id").cast("string"), F.lit(".html")), 2)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.encode("text", "utf-8").alias("content"))
    return _named(d, F.lit("/benchmark"), F.concat(F.lit("item "), F.col("id").cast("string"), F.lit(".txt")), 3)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` below /mail, a folder for each conversation and a file for each turn."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    d = d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.encode("text", "utf-8").alias("content"), "conv_id", "turn", "role")
    return _named(d, F.concat(F.lit("/mail/"), F.col("conv_id").cast("string")), F.concat(F.col("turn").cast("string"), F.lit(" "), "role", F.lit(".msg")), 4)


#: :func:`documents` without the contents, in SQL.
FILES_SQL = f"""
files AS (
  SELECT id, CAST(1 AS BIGINT) AS scan_id, parent || '/' || name AS path, parent, name, '.txt' AS ext, size, CAST(id * 60 + {EPOCH} AS DOUBLE) AS mtime, CAST(1 AS BIGINT) AS dev,
         CASE WHEN id % 50 = 0 THEN id + 1 ELSE id END AS inode, CAST(CASE WHEN id % 50 IN (0, 1) THEN 2 ELSE 1 END AS BIGINT) AS nlink, md5, text,
         CASE WHEN id % 17 = 0 THEN 'deleted' WHEN id % 19 = 0 THEN 'quarantined' ELSE 'present' END AS status
  FROM (SELECT doc_id AS id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, text,
               '/corpus/' || [{", ".join(f"'{f}'" for f in FOLDERS)}][CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % {len(FOLDERS)} + 1] || '/' || lang AS parent,
               'report ' || doc_id || CASE doc_id % 3 WHEN 1 THEN ' copy' WHEN 2 THEN ' (1)' ELSE '' END || '.txt' AS name
        FROM documents))
"""
