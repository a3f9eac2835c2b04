"""A scan from a folder to groups and suggestions, kept in a store."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.functions.images import EXTENSIONS, dhash_column
from mirrorlake.operators import caches, exact, fuzzy, groups, results, suggest
from mirrorlake.operators.lineage import cut, small
from mirrorlake.operators.store import Store
from mirrorlake.options import ScanOptions
from mirrorlake.sources import walker

PHASES = ("walk", "size", "quick", "md5", "verify", "group", "fuzzy")


class Progress:
    """Which of the phases runs, and since when; ``cancel`` stops Spark's jobs of this scan."""

    def __init__(self, tell: Callable[[dict], None] | None = None):
        self.phase, self.began, self.cancelled, self._tell = "", time.time(), False, tell
        self._group = f"scan-{time.time_ns()}"
        self._spark = None

    def begin(self, spark: object, phase: str) -> None:
        if self.cancelled:
            raise InterruptedError("cancelled")
        self._spark = spark
        spark.sparkContext.setJobGroup(self._group, phase, interruptOnCancel=True)
        self.phase = phase
        if self._tell:
            self._tell(self.state())

    def cancel(self) -> None:
        self.cancelled = True
        if self._spark:
            self._spark.sparkContext.cancelJobGroup(self._group)

    def state(self) -> dict[str, object]:
        done = total = 0
        if self._spark:
            tracker = self._spark.sparkContext.statusTracker()
            for job in tracker.getJobIdsForGroup(self._group):
                for stage in (tracker.getJobInfo(job) or ((), ()))[1] or ():
                    if info := tracker.getStageInfo(stage):
                        done, total = done + info.numCompletedTasks, total + info.numTasks
        n = PHASES.index(self.phase) + 1 if self.phase in PHASES else 0
        return {"phase": self.phase, "nth": n, "of": len(PHASES), "done": done, "total": total, "elapsed": time.time() - self.began}


def _images(store: Store, files: DataFrame) -> DataFrame | None:
    """(id, bits) of pictures: as cached, else of those that Spark's image source decodes; none without pictures."""
    pictures = files.filter(F.col("ext").isin(*EXTENSIONS))
    if not pictures.take(1):
        return None
    known = pictures.filter("dhash is not null").select("id", F.col("dhash").alias("bits"))
    named = pictures.filter("dhash is null").select("id", "path")
    folders = [r.parent for r in pictures.filter("dhash is null").select("parent").distinct().collect()]  # one a folder with new pictures
    if not folders:
        return known
    read = store.spark.read.format("image").option("dropInvalid", True).load(folders).select(F.regexp_replace(F.col("image.origin"), "^file:/+", "/").alias("path"), dhash_column(F.col("image")).alias("bits"))
    return known.unionByName(named.join(read, "path").select("id", "bits").dropna())


def _proven(store: Store, rows: DataFrame, now: float) -> DataFrame:
    """Clusters of equal content of (id, path, size, mtime, md5), and what was compared goes to the cache.

    A group whose files have all been found equal to its first, with sizes and
    times as they are now, is not read again.
    """
    rows = cut(exact.repeated(rows, "size", "md5").select("id", "path", "size", "mtime", "md5"))
    first = rows.groupBy("md5", "size").agg(F.min_by(F.struct("path", "mtime"), "path").alias("f"))
    both = rows.join(first, ["md5", "size"]).filter(F.col("path") != F.col("f.path"))
    pairs = both.select("md5", "size", F.col("f.path").alias("a_path"), F.col("size").alias("a_size"), F.col("f.mtime").alias("a_mtime"), F.col("path").alias("b_path"), F.col("size").alias("b_size"), F.col("mtime").alias("b_mtime"))
    known = caches.verify_lookup(pairs, caches.verify_upsert(store.read("verify_cache")))
    same = cut(known.groupBy("md5", "size").agg(F.bool_and(F.coalesce("same", F.lit(False))).alias("all")).filter("all").drop("all"))
    old = rows.join(small(same), ["md5", "size"], "left_semi").withColumn("strong", F.lit("as before"))
    new = cut(walker.hashed(rows.join(small(same), ["md5", "size"], "left_anti"), "strong").filter("strong is not null"))
    side = lambda c: new.select(F.col("path").alias(c + "_path"), F.col("strong").alias(c))
    said = pairs.join(side("a"), "a_path").join(side("b"), "b_path").withColumn("same", F.col("a") == F.col("b"))
    store.append("verify_cache", said.withColumn("seen_at", F.lit(now)))
    return cut(exact.numbered(old.select("id", "md5", "size", "strong").unionByName(new.select("id", "md5", "size", "strong"))))


def recover(store: Store, now: float | None = None) -> None:
    """To be called when the engine starts: scans that a stopped one left running were cancelled by that."""
    rows = store.read("scans")
    if rows.filter("state = 'running'").take(1):
        store.replace("scans", caches.finished(rows, time.time() if now is None else now))


def run(store: Store, root: str, o: ScanOptions | None = None, progress: Progress | None = None, now: float | None = None) -> int:
    """Scan ``root`` into the store; returns the scan's id.

    Exact groups and their suggestions are published before the near pass
    begins. Hashes are taken from the cache for versions it knows. A failure
    leaves what was published, and the scan as "error" or "cancelled". A quick rescan
    looks only at files of folders that changed since the last scan that was done.
    """
    o, progress, spark = o or ScanOptions(), progress or Progress(), store.spark
    root, now = walker.resolved(root, o.roots), time.time() if now is None else now
    scan = store.next_id("scans")
    began = time.time()
    finish = lambda state, **more: store.replace("scans", store.read("scans").filter(F.col("id") != scan).unionByName(store._shaped("scans", spark.createDataFrame([(scan, root, state, json.dumps(asdict(o)))], "id long, root string, state string, options string").withColumns({"started_at": F.lit(began), "finished_at": F.lit(time.time()), **{k: F.lit(v) for k, v in more.items()}}))))
    try:
        finish("running")
        progress.begin(spark, "walk")
        dirs = cut(walker.folders(spark, root, o))
        before = results.previous_scan(store.read("scans"), scan, root).first() if o.quick_rescan else None
        if before:
            known = store.read("dir_cache").filter(F.col("scan_id") == before.id)
            changed = dirs.join(caches.unchanged(dirs, known), "path", "left_anti")
            found = caches.carry_over(dirs, known, store.files(before.id), walker.listing(changed, o).withColumn("scan_id", F.lit(scan).cast("long")), scan)
        else:
            found = walker.tree(spark, root, o).withColumn("scan_id", F.lit(scan).cast("long"))
        store.append("dir_cache", dirs.withColumns({"scan_id": F.lit(scan), "seen_at": F.lit(now)}))
        found = found.withColumn("id", F.shiftrightunsigned(F.xxhash64("path", F.lit(scan)), 2))
        files = cut(caches.cache_lookup(found, caches.hash_upsert(store.read("hash_cache"))))

        progress.begin(spark, "size")
        rows = cut(exact.size_candidates(files))
        progress.begin(spark, "quick")
        rows = cut(walker.hashed(rows, "quick"))
        quick = rows.select("id", "quick")
        rows = exact.repeated(rows, "size", "quick")
        progress.begin(spark, "md5")
        rows = cut(walker.hashed(rows, "md5"))
        md5 = rows.select("id", "md5")
        progress.begin(spark, "verify")
        if o.verify_bytes:
            clusters = _proven(store, rows, now)
        else:
            clusters = cut(exact.verified_clusters(rows, verify=False))
        files = files.drop("quick", "md5").join(quick, "id", "left").join(md5, "id", "left").withColumn("status", F.lit("present"))
        progress.begin(spark, "group")
        _publish(store, groups.exact_members(clusters), files, "exact", now, o)

        pairs = None
        if o.near_duplicates:
            progress.begin(spark, "fuzzy")
            listed = fuzzy.fuzzy_eligible(files, fuzzy.redundant(clusters), o)
            wanted = walker.hashed(listed.filter("wants_signature"), "fuzzy", o.fuzzy_max_bytes)
            signed = cut(wanted.select("id", "size", "name", "ext", "fuzzy"))
            pairs = cut(fuzzy.mixed_scores(fuzzy.signature_pairs(signed, o, fuzzy.least_content(o)), signed).filter(F.col("score") >= o.near_threshold))
            images = _images(store, listed.filter("is_image")) if o.image_similarity else None
            if images is not None:
                images = cut(images)
                files = files.drop("dhash").join(images.select("id", F.col("bits").alias("dhash")), "id", "left")
                more = fuzzy.image_pairs(images, o).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
                pairs = pairs.unionByName(more.select("a", "b", F.col("score").alias("content"), "score"))
            members = fuzzy.near_members(pairs, files, clusters.select("id"), o, signed)
            _publish(store, cut(members), files, "near", now, o)
            files = files.drop("fuzzy").join(signed.select("id", "fuzzy"), "id", "left")
        files = cut(files)
        store.append("files", files)
        store.append("hash_cache", files.filter("coalesce(quick, md5, fuzzy) is not null or dhash is not null").select("path", "size", "mtime", *caches.HASHES).withColumn("seen_at", F.lit(now)))
        made = store.read("groups").filter(F.col("scan_id") == scan)
        counters = results.scan_counters(files, made).first()
        finish("done", **({k: v for k, v in counters.asDict().items() if k != "scan_id"} if counters else {}))
    except Exception as e:
        stopped = progress.cancelled or isinstance(e, InterruptedError)
        finish("cancelled" if stopped else "error", error=str(e)[:2000])
        if not stopped:
            raise
    return scan


def _publish(store: Store, members: DataFrame, files: DataFrame, kind: str, now: float, o: ScanOptions) -> None:
    """Append groups with their members and suggestions. Ids of files, and so of groups, are a scan's own."""
    members = cut(members)
    rows = cut(groups.group_rows(members, files, kind))
    said = suggest.suggestions(rows, members, files, now, o)
    store.append("groups", rows)
    store.append("group_members", members)
    store.append("suggestions", said)
