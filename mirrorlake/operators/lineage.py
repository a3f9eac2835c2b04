"""Cutting lineage and choosing join strategies by measured size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes up to which a side may be broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (tests, a laptop) a folder of
    our own is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # read at each checkpoint
    now = sc.getCheckpointDir()
    if now is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mirrorlake-"))
        now = sc.getCheckpointDir()
    return named or now


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there on.

    The copy survives lost executors. Spark's cleaner removes it once no plan refers
    to it any more, after a garbage collection of the driver; what a session that ends
    before leaves lies below the checkpoint folder and can go with it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of ours that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        fields = len(kind.elementType.fields) + 2 if isinstance(kind.elementType, StructType) else 1
        return F.coalesce(F.size(column), F.lit(0)) * 8 * fields + 24
    return F.lit(8 * (len(kind.fields) + 2) if isinstance(kind, StructType) else 8)


def row_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take in memory; one pass over ``df``."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(32))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``most`` bytes.

    ``df`` should be cheap to read, e.g. the result of :func:`cut`. Beyond the
    bound the plan is left to Spark, which shuffles both sides.
    """
    return F.broadcast(df) if row_bytes(df) <= most else df
