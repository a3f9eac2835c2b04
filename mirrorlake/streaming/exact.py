"""Exact duplicates in a stream (an extension: older tools scan, and look again).

The state is a table of signatures seen: the first file of each content
passes, later ones are copies. With a watermark the state is bounded by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorlake.functions import signatures
from mirrorlake.operators import exact, groups


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def signed(stream: DataFrame) -> DataFrame:
    """``stream`` (content, ...) with size and MD5."""
    return stream.withColumns({"size": F.octet_length("content").cast("long"), "md5": signatures.full_md5(F.col("content"))})


def first_of_each(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each content. With ``event_time``, of each content within ``delay``; state older than that goes."""
    rows = signed(stream)
    if event_time is None:
        return rows.dropDuplicates(["md5", "size"])
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["md5", "size"])


def copies_by_window(stream: DataFrame, event_time: str = "ts", length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, md5, size, files) of contents that came more than once in a window; late rows beyond ``delay`` are dropped."""
    rows = signed(stream).withWatermark(event_time, delay)
    many = rows.groupBy(F.window(event_time, length), "md5", "size").agg(F.count("*").alias("files"), F.min("id").alias("first_id"))
    return many.filter("files > 1").select(F.col("window.start").alias("window_start"), "md5", "size", "files", "first_id")


def run_exact(stream: DataFrame, table: str, checkpoint: str, tell: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Keep the table of signatures at ``table`` and report the exact groups that each batch changes.

    Batches are written to a folder of their own, so that one that is run again
    replaces itself.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = signed(batch).select("id", "scan_id", "size", "md5", "parent", "name")
        rows.write.mode("overwrite").parquet(f"{table}/batch={n}")
        if tell:
            known = spark.read.parquet(table).drop("batch")
            touched = known.join(spark.read.parquet(f"{table}/batch={n}").select("md5", "size").distinct(), ["md5", "size"], "left_semi")
            clusters = exact.verified_clusters(touched, verify=False)
            tell(n, groups.exact_groups(touched, clusters))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
