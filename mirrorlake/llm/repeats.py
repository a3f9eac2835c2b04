"""Repeated passages across documents, by suffix arrays of shards.

1. Winnowing (Schleimer et al., 2003) picks fingerprints of ``passage // 2`` words
   so that any two equal passages of ``passage`` words have one in common. Counted
   over the whole corpus, they leave the regions of documents that may repeat;
   nothing that repeats is lost.
2. Regions that share fingerprints go to the same shard: each takes the least
   fingerprint it can reach in a few rounds. Where that leaves a fingerprint in
   several shards, the text around all its places is sent to one more.
3. A shard's regions are one text in a file, equal ones once, and external induced
   sorting (:mod:`mirrorlake.llm.suffixes`) gives its suffixes in order with their
   common prefixes. Stretches of suffixes with ``passage`` words in common, from two
   documents or more, are the repeats. Rows go straight into files and results are
   read from files in blocks, so a task needs as much memory for any shard.
4. A label of more than ``label_words`` words, such as a licence that a third of all
   documents have, would be one task's. Its passages are hashed instead, 128 bits each,
   and counted by an aggregate, which finds the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorlake.llm import text as T
from mirrorlake.llm.suffixes import Log, Scratch, SortOptions, blocks, suffix_order
from mirrorlake.operators.lineage import cut, shared_dir, small


@dataclass(frozen=True)
class RepeatOptions:
    """``passage``: words that must repeat. ``shard_words``: words of a shard on average;
    ``label_words``: of regions that share fingerprints, beyond which passages are hashed.

    ``scratch``: folder for the sort's files, which each task makes and removes; by default
    that of spark.checkpoint.dir if it is mounted, else spark.local.dir as on the executors.
    """

    passage: int = 50
    shard_words: int = 1_000_000
    label_words: int = 4_000_000
    rounds: int = 3
    scratch: str | None = None
    sort: SortOptions = SortOptions()

    @property
    def gram(self) -> int:
        return max(1, self.passage // 2)

    @property
    def reach(self) -> int:
        """Fingerprints of which one is picked; any passage has so many."""
        return self.passage - self.gram + 1


def _scratch(spark: SparkSession, o: RepeatOptions) -> str | None:
    """The folder of the sort's files, None for the executors' own."""
    where = urlparse(o.scratch or shared_dir(spark))
    if where.scheme in ("", "file"):
        return where.path
    return spark.conf.get("spark.local.dir", None)


def _own_scratch() -> str:
    """Where this executor spills; a lost one's tasks start again elsewhere."""
    named = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS")
    if not named:
        raise ValueError("the sort needs a mounted folder: RepeatOptions.scratch, spark.local.dir or SPARK_LOCAL_DIRS")
    return named.split(",")[0]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).filter("doc_id is not null")


def _picked(gram: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
    """Places of the least hash (the last of equal ones) of each ``reach`` in a row within a document."""
    n = len(gram)
    if not n:
        return np.zeros(0, np.int64)
    # window minima by doubling, on hashes with documents kept apart by validity
    low, at = gram.copy(), np.arange(n)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        m = n - step
        if m > 0:
            other = low[step:]
            better = other <= low[:m]
            low[:m] = np.where(better, other, low[:m])
            at[:m] = np.where(better, at[step:], at[:m])
        width += step
    count = np.maximum(np.diff(place) - reach + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = place[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(at[start])


def fingerprints(docs: DataFrame, o: RepeatOptions) -> DataFrame:
    """(fp, doc_id, at) of the picked fingerprints, ``at`` in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                gram, place = T.shingles(*T.words(raw, offs[lo : hi + 1]), o.gram)
                at = _picked(gram, place, o.reach)
                if len(at):
                    doc = np.searchsorted(place, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(T.as_signed(gram[at])), pa.array(ids[lo + doc]), pa.array((at - place[doc]).astype(np.int32))], ["fp", "doc_id", "at"])

    return _source(docs).mapInArrow(run, "fp long, doc_id long, at int")


def _regions(live: DataFrame, o: RepeatOptions) -> DataFrame:
    """``live`` with the first fingerprint's place of its region, where the next is never out of reach."""
    w = Window.partitionBy("doc_id").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(w) <= o.reach, F.lit(0)).otherwise(F.lit(1))
    marked = live.withColumn("new", new).withColumn("region", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.select("fp", "doc_id", "at", "region")


def pieces(live: DataFrame, o: RepeatOptions) -> DataFrame:
    """(doc_id, label, begin, stop): stretches of words and what they are grouped by."""
    rows = cut(_regions(live, o).withColumn("rid", F.xxhash64("doc_id", "region")))
    extent = rows.groupBy("rid", "doc_id").agg(F.min("fp").alias("label"), (F.min("at") - o.reach).alias("begin"), (F.max("at") + o.gram + o.reach).alias("stop"))
    link = rows.select("rid", "fp").distinct()
    label = extent.select("rid", "label")
    for _ in range(o.rounds):
        to_fp = link.join(label, "rid").groupBy("fp").agg(F.min("label").alias("label"))
        label = cut(link.join(to_fp, "fp").groupBy("rid").agg(F.min("label").alias("label")))
    apart = link.join(label, "rid").groupBy("fp").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("fp")
    more = rows.join(apart, "fp").select("doc_id", F.xxhash64("fp").alias("label"), (F.col("at") - o.reach).alias("begin"), (F.col("at") + o.passage).alias("stop"))
    more = more.groupBy("doc_id", "label", "begin").agg(F.max("stop").alias("stop"))
    return extent.drop("label").join(label, "rid").select("doc_id", "label", "begin", "stop").unionByName(more.select("doc_id", "label", "begin", "stop"))


def _stretches(docs: DataFrame, wanted: DataFrame, o: RepeatOptions) -> DataFrame:
    """(doc_id, text, p) of the documents that have ``wanted`` stretches, p being their (shard, begin, stop)."""
    by_doc = cut(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "begin", "stop")).alias("p")))
    return _source(docs).join(small(by_doc), "doc_id").select("doc_id", "text", "p")


def _texts(docs: DataFrame, wanted: DataFrame, o: RepeatOptions) -> DataFrame:
    """(shard, whole, doc_id, begin, words) of the wanted stretches, words as 64-bit hashes, and a number of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = T.buffers(b.column(1))
            ids, lists = b.column(0), b.column(2)
            for lo, hi in T.slices(offs):
                word, first = T.words(raw, offs[lo : hi + 1])
                word = word >> np.uint64(1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(word) * (2 * np.arange(len(word), dtype=np.uint64) + np.uint64(1)))])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(word))])
                out: list[tuple] = []
                for d in range(lo, hi):
                    start, end = int(first[d - lo]), int(first[d - lo + 1])
                    for p in lists[d].as_py():
                        x, y = start + max(0, p["begin"]), min(end, start + p["stop"])
                        if x < y:  # the weights of places count from x
                            whole = (int(total[y]) - int(total[x]) - 2 * x * (int(sums[y]) - int(sums[x]))) % 2**64
                            out.append((p["shard"], whole - 2**63, ids[d].as_py(), x - start, word[x:y].astype(np.int64).tobytes()))
                if out:
                    s, h, i, a, w = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(h, pa.int64()), pa.array(i, pa.int64()), pa.array(a, pa.int32()), pa.array(w, pa.binary())], ["shard", "whole", "doc_id", "begin", "words"])

    return _stretches(docs, wanted, o).mapInArrow(run, "shard int, whole long, doc_id long, begin int, words binary")


class _Shard:
    """The stretches of one shard in files: each different text once, and who has it.

    Rows come in the order of ``whole``, document and place.
    """

    _TEXT = np.dtype([("start", np.int64), ("size", np.int64), ("least", np.int64), ("most", np.int64), ("count", np.int64), ("first", np.int64)])
    _OWNER = np.dtype([("doc", np.int64), ("begin", np.int64)])

    def __init__(self, scratch: Scratch, o: RepeatOptions):
        self.scratch, self.o = scratch, o
        self.words, self.texts, self.owners = (Log(scratch, k, o.sort.buffer) for k in (np.int64, self._TEXT, self._OWNER))
        self.now: list[int] | None = None
        self.same: tuple | None = None
        self.held: tuple[list, list] = ([], [])

    def add(self, whole: int, doc: int, begin: int, words: bytes) -> None:
        mark = (whole, len(words))
        if self.now is None or self.same[0] != mark:
            self._close()
            w = np.frombuffer(words, np.int64)
            self.now = [self.words.n, len(w), doc, doc, 0, self.owners.n + len(self.held[1])]
            self.words.add(np.append(w, -len(self.held[0]) - self.texts.n - 1))  # ends are symbols found nowhere else, the last the least
        elif self.same[1:] == (doc, begin):
            return
        self.same = (mark, doc, begin)
        self.now[3] = max(self.now[3], doc)
        self.now[2] = min(self.now[2], doc)
        self.now[4] += 1
        self.held[1].append((doc, begin))
        if len(self.held[1]) >= 4096:
            self._write()

    def _close(self) -> None:
        if self.now is not None:
            self.held[0].append(tuple(self.now))

    def _write(self) -> None:
        for log, rows, kind in zip((self.texts, self.owners), self.held, (self._TEXT, self._OWNER), strict=True):
            if rows:
                log.add(np.array(rows, kind))
                rows.clear()

    def repeats(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc_id, begin, stop, first_doc, copies) of the stretches that repeat, in parts."""
        self._close()
        self._write()
        self.now = None
        o, block, n = self.o, max(64, self.o.sort.buffer), self.words.n
        texts, owners = self.texts.all(), self.owners.all()
        start = np.ascontiguousarray(texts["start"]) if len(texts) < block else texts["start"]
        pos, lcp = suffix_order(self.words.all(), self.scratch, replace(o.sort, cap=o.passage))
        groups, held = Log(self.scratch, np.dtype([("least", np.int64), ("most", np.int64), ("count", np.int64)]), block), None

        def of(p: np.ndarray) -> np.ndarray:
            return np.searchsorted(start, p, "right") - 1

        for lo, hi in blocks(len(pos), block):  # groups of suffixes with a passage in common
            t = texts[of(pos[lo:hi])]
            head = np.flatnonzero(lcp[lo:hi] < o.passage)
            edge = head if len(head) and head[0] == 0 else np.append(0, head)
            rows = np.empty(len(edge), groups.dtype)
            rows["least"], rows["most"], rows["count"] = np.minimum.reduceat(t["least"], edge), np.maximum.reduceat(t["most"], edge), np.add.reduceat(t["count"], edge)
            if held is not None and (not len(head) or head[0] > 0):
                rows["least"][0], rows["most"][0] = min(rows["least"][0], held["least"][0]), max(rows["most"][0], held["most"][0])
                rows["count"][0] += held["count"][0]
            elif held is not None:
                groups.add(held)
            groups.add(rows[:-1])
            held = rows[-1:].copy()
        if held is not None:
            groups.add(held)
        groups, seen = groups.all(), -1
        least, count = self.scratch.empty(n, np.int64), self.scratch.empty(n, np.int64)
        for lo, hi in blocks(len(pos), block):
            p = pos[lo:hi]
            nth = seen + np.cumsum(lcp[lo:hi] < o.passage)
            seen = int(nth[-1])
            t, g = texts[of(p)], groups[nth]
            good = (g["least"] != g["most"]) & (p - t["start"] + o.passage <= t["size"])
            least[p[good]], count[p[good]] = g["least"][good], g["count"][good]
        open_: tuple | None = None
        for lo, hi in blocks(n, block):
            place = np.flatnonzero(count[lo:hi]) + lo
            if not len(place):
                continue
            edge = np.flatnonzero(np.append(True, np.diff(place) > o.passage))
            a, z = place[edge], place[np.append(edge[1:], len(place)) - 1]
            low, most = np.minimum.reduceat(least[place], edge), np.maximum.reduceat(count[place], edge)
            if open_ is not None:
                if a[0] - open_[1] <= o.passage:
                    a[0], low[0], most[0] = open_[0], min(low[0], open_[2]), max(most[0], open_[3])
                else:
                    a, z, low, most = (np.append(x, y) for x, y in zip(open_, (a, z, low, most), strict=True))
            yield from self._spans(a[:-1], z[:-1], low[:-1], most[:-1], texts, of, owners, block)
            open_ = int(a[-1]), int(z[-1]), int(low[-1]), int(most[-1])
        if open_ is not None:
            yield from self._spans(*(np.array([x]) for x in open_), texts, of, owners, block)

    def _spans(self, a: np.ndarray, z: np.ndarray, low: np.ndarray, most: np.ndarray, texts: np.ndarray, of: object, owners: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Each span for all that have its text."""
        if not len(a):
            return
        t = texts[of(a)]
        total = np.cumsum(t["count"])
        for x in range(0, int(total[-1]), block):
            row = np.arange(x, min(x + block, int(total[-1])))
            k = np.searchsorted(total, row, "right")
            own = owners[t["first"][k] + row - (total[k] - t["count"][k])]
            begin = own["begin"] + a[k] - t["start"][k]
            yield own["doc"], begin, begin + z[k] - a[k] + self.o.passage, low[k], most[k]


def _sorted_shards(rows: DataFrame, o: RepeatOptions, root: str | None) -> DataFrame:
    """(doc_id, begin, stop, first_doc, copies) of the repeats found in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: _Shard) -> Iterator[pa.RecordBatch]:
            for columns in shard.repeats():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "begin", "stop", "first_doc", "copies"])

        now, shard, scratch = None, None, None
        try:
            for b in batches:
                for s, h, d, a, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if s != now:
                        if shard is not None:
                            yield from found(shard)
                            scratch.__exit__()
                        scratch = Scratch(root or _own_scratch())
                        now, shard = s, _Shard(scratch, o)
                    shard.add(h, d, a, w)
            if shard is not None:
                yield from found(shard)
        finally:
            if scratch is not None:
                scratch.__exit__()

    rows = rows.repartition("shard").sortWithinPartitions("shard", "whole", "doc_id", "begin")
    return rows.mapInArrow(run, "doc_id long, begin long, stop long, first_doc long, copies long")


def _hashed(docs: DataFrame, wanted: DataFrame, o: RepeatOptions) -> DataFrame:
    """The same as :func:`_sorted_shards` of stretches that are too many for a task, by counting 128-bit hashes of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                word, first = T.words(raw, offs[lo : hi + 1])
                (x, place), (y, _) = T.shingles(word, first, o.passage), T.shingles(T.mix(word), first, o.passage)
                for d in range(lo, hi):
                    n = int(place[d - lo + 1] - place[d - lo])
                    inside = np.zeros(n, bool)
                    for p in b.column(2)[d].as_py():
                        inside[max(0, p["begin"]) : max(0, p["stop"] - o.passage + 1)] = True
                    at = np.flatnonzero(inside)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(T.as_signed(x[place[d - lo] + at])), pa.array(T.as_signed(y[place[d - lo] + at])), pa.array(np.full(len(at), ids[d]), pa.int64()), pa.array(at, pa.int64())], ["x", "y", "doc_id", "begin"])

    rows = cut(_stretches(docs, wanted, o).mapInArrow(run, "x long, y long, doc_id long, begin long").distinct())
    many = rows.groupBy("x", "y").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("most"), F.count("*").alias("copies")).filter("first_doc <> most")
    return rows.join(many, ["x", "y"]).select("doc_id", "begin", (F.col("begin") + o.passage).alias("stop"), "first_doc", "copies")


def repeated_passages(docs: DataFrame, options: RepeatOptions | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, first_doc, copies): passages that other documents have too.

    Every stretch of a document made of passages of ``passage`` words or more, each
    found in another document, is one row; ``first_doc`` is the least id of the
    documents that have one of them, ``copies`` the most places that one is found
    at. Case and punctuation don't count. Passages repeated within one document
    only are left alone, and so are texts shorter than a passage, null or empty,
    and rows without an id. Rows that repeat an id are one document. Ids are whole
    numbers. No documents give no rows.
    """
    o = options or RepeatOptions()
    every = cut(fingerprints(docs, o))
    many = cut(every.groupBy("fp").count().filter("count > 1").select("fp"))
    live = cut(every.join(small(many), "fp", "left_semi").select("fp", "doc_id", "at").distinct())
    wanted = cut(pieces(live, o))
    sizes = wanted.groupBy("label").agg(F.sum(F.col("stop") - F.col("begin")).alias("words"))
    hot = cut(sizes.filter(F.col("words") > o.label_words).select("label"))
    total = wanted.agg(F.coalesce(F.sum(F.col("stop") - F.col("begin")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // o.shard_words))
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int"))
    some = wanted.join(small(hot), "label", "left_anti")
    found = _sorted_shards(_texts(docs, some.select("doc_id", "shard", "begin", "stop"), o), o, _scratch(docs.sparkSession, o))
    if hot.take(1):
        found = found.unionByName(_hashed(docs, wanted.join(small(hot), "label", "left_semi").select("doc_id", "shard", "begin", "stop"), o))
    w = Window.partitionBy("doc_id").orderBy("begin", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.withColumn("new", F.when(F.col("begin") <= before, 0).otherwise(1)).withColumn("nth", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("doc_id", "nth").agg(F.min("begin").alias("first_word"), F.max("stop").alias("stop"), F.min("first_doc").alias("first_doc"), F.max("copies").alias("copies"))
    return merged.select("doc_id", "first_word", (F.col("stop") - F.col("first_word")).alias("n_words"), "first_doc", "copies")
