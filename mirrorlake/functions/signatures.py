"""Signatures of contents: partial, whole and strong hashes, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 64 << 10


def quick_hash(content: Column, size: Column) -> Column:
    """MD5 of the size and the first 64 KiB, with the last 64 KiB of what is longer than both."""
    tail = F.when(size > 2 * EDGE, F.substring(content, -EDGE, EDGE)).otherwise(F.lit(b""))
    return F.md5(F.concat(size.cast("string").cast("binary"), F.substring(content, 1, EDGE), tail))


def full_md5(content: Column) -> Column:
    return F.md5(content)


def strong_hash(content: Column) -> Column:
    """Stands for the content where equality is to be proven: 512 bits, and collision-free for all that is known."""
    return F.sha2(content, 512)


def dhash_similarity(a: Column, b: Column) -> Column:
    """Percent of 64 bits that agree, to the nearest even whole number."""
    return F.bround((64 - F.bit_count(a.bitwiseXOR(b))) * 100 / 64).cast("int")
