"""Benchmark decontamination: size-partitioned MinHash containment search.

After Zhu et al., "LSH Ensemble: Internet-Scale Domain Search" (2016). Items are
partitioned by the size of their shingle sets into classes of (size / 2, size].
For each class, documents are read as windows of two blocks of ``size`` shingles
that overlap by one block, so an item that stands in a document lies inside a
window at most four times its size, however long the document is. At such a
ratio a contained item shares a minwise shingle with its window under at least
one of ``HASHES`` functions almost surely; each hit is then verified by the exact
share of the item's shingles in the window.

Documents never shuffle. A pass over them looks up the minima of all windows in a
blocked Bloom filter of the items' minima, of ``filter_bytes`` at most at ``_BITS``
bits each, and lets only the few (window, key) go on that are in it; a larger
benchmark takes several passes, each with a filter of some of the keys. The keys that
are really there give (document, item, window) to verify, and the shingles of these
windows are read from the documents concerned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm import text as T
from mirrorlake.operators.lineage import cut, small

HASHES = 24
#: Bits of the filter for each key; about one unknown key in 2,000 passes.
_BITS = 24


@dataclass(frozen=True)
class LeakOptions:
    """``threshold``: share of an item's shingles from which a window counts as holding it.

    ``filter_bytes``: of the filter that each pass takes along; a power of two, 64 at least.
    """

    threshold: float = 0.8
    shingle: int = 3
    filter_bytes: int = 32 << 20
    seed: int = 11


def _functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, HASHES, dtype=np.uint64)


def _minima(sh: np.ndarray, begin: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minima of each function over ranges of shingles, as [range, function]."""
    low = np.empty((len(begin), HASHES), np.uint64)
    for i, m in enumerate(mult):
        low[:, i] = np.minimum.reduceat(sh * m, begin)
    return low


def item_index(items: DataFrame, o: LeakOptions) -> DataFrame:
    """(item_id, whole, size, shingles, keys) of the items that have ``shingle`` words or more.

    ``whole`` is the same for items of equal shingles.
    """
    mult, salt = _functions(o.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = T.buffers(batch.column(1))
            sh, place = T.shingles(*T.words(raw, offs), o.shingle)
            some = np.flatnonzero(np.diff(place) > 0)
            if not len(some):
                continue
            keys = T.as_signed(T.mix(_minima(sh, place[:-1][some], mult) ^ salt))
            each = [np.unique(T.as_signed(sh[place[d] : place[d + 1]])) for d in some]
            size = [1 << (int(place[d + 1] - place[d]) - 1).bit_length() for d in some]
            whole = [int(np.bitwise_xor.reduce(T.mix(x.view(np.uint64))) >> np.uint64(1)) ^ s for x, s in zip(each, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(whole, pa.int64()), pa.array(size, pa.int64()), pa.array(each, pa.list_(pa.int64())), pa.array(list(keys), pa.list_(pa.int64()))], ["item_id", "whole", "size", "shingles", "keys"])

    src = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).filter("item_id is not null")
    return src.mapInArrow(run, "item_id long, whole long, size long, shingles array<long>, keys array<long>")


def _places(key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the 64-bit block of the filter, and six of its bits."""
    h = T.mix(key.view(np.uint64))
    bits = np.zeros(len(h), np.uint64)
    for i in range(6):
        bits |= np.uint64(1) << (h >> np.uint64(6 * i + 26) & np.uint64(63))
    return (h & np.uint64(blocks - 1)).astype(np.int64), bits


def _filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter of the (key); made where the keys are, in parts of 4,096 blocks, and put together here."""
    part = min(blocks, 4096)

    def made(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy()
        bits = np.zeros(part, np.uint64)
        block, own = _places(key, blocks)
        np.bitwise_or.at(bits, block % part, own)
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_places(key, blocks)[0] // part)], ["key", "part"])

    rows = keys.mapInArrow(placed, "key long, part long").groupBy("part").applyInArrow(made, "part long, bits binary")
    out = np.zeros(blocks, np.uint64)
    for r in rows.collect():  # filter_bytes at most
        out[r.part * part : (r.part + 1) * part] = np.frombuffer(r.bits, np.uint64)
    return out


def _windows(sh: np.ndarray, place: np.ndarray, sizes: list[int], mult: np.ndarray, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(class, document, first shingle, keys [window, function]) of all windows, class by class."""
    low, was = None, 0
    for size in sizes:
        count = -(-np.diff(place) // size)
        doc = np.repeat(np.arange(len(count)), count)
        begin = place[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
        if low is None:
            low = _minima(sh, begin, mult)
        else:  # blocks of this class are made of whole blocks of the class before
            low = np.minimum.reduceat(low, np.searchsorted(was, begin), axis=0)
        was = begin
        both = low.copy()
        next_ = np.flatnonzero(doc[1:] == doc[:-1])
        both[next_] = np.minimum(both[next_], low[next_ + 1])
        yield size, doc, begin, T.as_signed(T.mix(both ^ salt))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).filter("doc_id is not null")


def _hits(docs: DataFrame, sizes: list[int], known: np.ndarray, o: LeakOptions) -> DataFrame:
    """(doc_id, size, first_word, key) of the windows' keys that the filter lets through."""
    mult, salt = _functions(o.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offs = T.buffers(batch.column(1))
            for lo, hi in T.slices(offs):
                sh, place = T.shingles(*T.words(raw, offs[lo : hi + 1]), o.shingle)
                if not len(sh):
                    continue
                for size, doc, begin, keys in _windows(sh, place, sizes, mult, salt):
                    flat = keys.ravel() ^ size  # the same minimum in another class is another key
                    block, bits = _places(flat, len(known))
                    at = np.flatnonzero(known[block] & bits == bits)
                    if len(at):
                        row = at // HASHES
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc[row]], pa.int64()), pa.array(np.full(len(at), size), pa.int64()), pa.array(begin[row] - place[:-1][doc[row]], pa.int64()), pa.array(flat[at])], ["doc_id", "size", "first_word", "key"])

    return _source(docs).mapInArrow(run, "doc_id long, size long, first_word long, key long")


def _seen(docs: DataFrame, wanted: DataFrame, o: LeakOptions) -> DataFrame:
    """(doc_id, whole, first_word, seen): the shingles of the ``wanted`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                sh, place = T.shingles(*T.words(raw, offs[lo : hi + 1]), o.shingle)
                part = b.column(2).slice(lo, hi - lo)
                flat = part.flatten()
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                whole, size, first = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                begin = np.minimum(place[:-1][doc] + first, place[1:][doc])
                stop = np.minimum(begin + 2 * size, place[1:][doc])
                each = [T.as_signed(sh[x:y]) for x, y in zip(begin, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(whole, pa.int64()), pa.array(first, pa.int64()), pa.array(each, pa.list_(pa.int64()))], ["doc_id", "whole", "first_word", "seen"])

    by_doc = cut(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("whole", "size", "first_word")).alias("w")))
    return _source(docs).join(small(by_doc), "doc_id").select("doc_id", "text", "w").mapInArrow(run, "doc_id long, whole long, first_word long, seen array<long>")


def leaks(docs: DataFrame, items: DataFrame, options: LeakOptions | None = None) -> DataFrame:
    """(doc_id, item_id, containment, first_word): which documents hold which items.

    ``containment`` is the share of the item's distinct word shingles within the
    best window, ``first_word`` where the first such window begins. Case and
    punctuation don't count. Items of fewer words than a shingle, and null or
    empty texts on either side, match nothing; rows without an id are left out.
    Rows that repeat an id give one result, the best. Ids are whole numbers. Either
    table empty: no rows.
    """
    o = options or LeakOptions()
    every = cut(item_index(items, o))
    index = cut(every.groupBy("whole", "size").agg(F.first("shingles").alias("shingles"), F.first("keys").alias("keys")))
    keys = cut(index.select("whole", "size", F.explode("keys").alias("key")).select("whole", "size", F.col("key").bitwiseXOR(F.col("size")).alias("key")))
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())
    number = keys.select("key").distinct().count()
    most = max(8, o.filter_bytes // 8)
    passes = max(1, -(-number * _BITS // (64 * most)))
    blocks = min(1 << (most.bit_length() - 1), 1 << max(3, (number * _BITS // (64 * passes)).bit_length()))
    found = None
    for i in range(passes if sizes else 0):
        some = keys.select("key").filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == i) if passes > 1 else keys.select("key")
        now = _hits(docs, sizes, _filter(some, blocks), o)
        found = now if found is None else found.unionByName(now)
    if found is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("false").selectExpr("doc_id", "doc_id as item_id", "cast(0 as double) as containment", "doc_id as first_word")
    pairs = cut(found.join(small(keys), ["size", "key"]).select("doc_id", "whole", "size", "first_word").distinct())
    share = F.size(F.array_intersect("shingles", "seen")) / F.size("shingles")
    best = _seen(docs, pairs, o).join(small(index.select("whole", "shingles")), "whole").select("doc_id", "whole", "first_word", share.alias("containment")).filter(F.col("containment") >= o.threshold)
    best = best.groupBy("doc_id", "whole").agg(F.max("containment").alias("containment"), F.max_by("first_word", F.struct("containment", -F.col("first_word"))).alias("first_word"))
    best = best.join(small(every.select("whole", "item_id").distinct()), "whole")
    return best.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"), F.max_by("first_word", F.struct("containment", -F.col("first_word"))).alias("first_word"))


def drop_leaks(docs: DataFrame, items: DataFrame, options: LeakOptions | None = None) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay."""
    gone = leaks(docs, items, options).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(small(cut(gone)), "doc_id", "left_anti").select(docs.columns)
