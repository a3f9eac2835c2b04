"""Tables that remember: hashes of file versions, comparisons of pairs, folders, states.

All are append-only logs of observations, read through latest-wins aggregates, so
an update never rewrites what others read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds within which two times of change are the same.
TOLERANCE = 0.001
HASHES = ("quick", "md5", "fuzzy", "dhash")


def same_time(a: Column, b: Column) -> Column:
    return F.abs(a - b) < TOLERANCE


def hash_upsert(log: DataFrame) -> DataFrame:
    """One row for each version of a file, (path, size, mtime): of each hash the latest that is not null.

    An edited file is another version and inherits nothing.
    """
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seen_at"))).alias(c) for c in HASHES]
    return log.groupBy("path", "size", "mtime").agg(*latest, F.max("seen_at").alias("seen_at"))


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` with the cached hashes of the same path, size and time; of several the latest seen. Null without."""
    known = cache.select("path", "size", F.col("mtime").alias("_mtime"), F.struct("seen_at", *HASHES).alias("_c"))
    rest = [c for c in files.columns if c not in HASHES]
    keys = [c for c in rest if c != "content"]
    hits = files.select(*keys).join(known, ["path", "size"]).filter(same_time(F.col("mtime"), F.col("_mtime"))).groupBy("path", "size", "mtime").agg(F.max("_c").alias("_c"))
    return files.select(*rest).join(hits, ["path", "size", "mtime"], "left").select(*rest, *(F.col(f"_c.{c}").alias(c) for c in HASHES))


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """``cache`` without the versions of the changed paths."""
    return cache.join(changed.select("path").distinct(), "path", "left_anti").select(cache.columns)


def invalidate_verified(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Comparisons of which neither side changed."""
    gone = changed.select("path").distinct()
    return cache.join(gone.withColumnRenamed("path", "a_path"), "a_path", "left_anti").join(gone.withColumnRenamed("path", "b_path"), "b_path", "left_anti").select(cache.columns)


def ordered_pair(rows: DataFrame) -> DataFrame:
    """Comparisons with the lesser path first, sizes and times along."""
    swap = F.col("a_path") > F.col("b_path")
    cols = {f"{x}_{c}": F.when(swap, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")) for x, y in (("a", "b"), ("b", "a")) for c in ("path", "size", "mtime")}
    return rows.withColumns(cols)


def verify_upsert(log: DataFrame) -> DataFrame:
    """The latest comparison of each pair of paths."""
    rows = ordered_pair(log)
    last = F.max_by(F.struct("a_size", "a_mtime", "b_size", "b_mtime", "same"), "seen_at")
    return rows.groupBy("a_path", "b_path").agg(last.alias("v"), F.max("seen_at").alias("seen_at")).select("a_path", "b_path", "v.*", "seen_at")


def verify_lookup(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """``pairs`` (a_path, a_size, a_mtime, b_...) in order, with ``same`` where both sides are as they were compared."""
    old = cache.select("a_path", "b_path", *(F.col(c).alias("_" + c) for c in ("a_size", "a_mtime", "b_size", "b_mtime", "same")))
    rows = ordered_pair(pairs).join(old, ["a_path", "b_path"], "left")
    valid = (F.col("a_size") == F.col("_a_size")) & (F.col("b_size") == F.col("_b_size")) & same_time(F.col("a_mtime"), F.col("_a_mtime")) & same_time(F.col("b_mtime"), F.col("_b_mtime"))
    return rows.withColumn("same", F.when(valid, F.col("_same"))).drop("_a_size", "_a_mtime", "_b_size", "_b_mtime", "_same")


def dir_upsert(log: DataFrame) -> DataFrame:
    """The latest time of change of each folder in each scan."""
    return log.groupBy("scan_id", "path").agg(F.max_by("mtime", "seen_at").alias("mtime"), F.max("seen_at").alias("seen_at"))


def current_status(files: DataFrame, log: DataFrame) -> DataFrame:
    """``files`` with the latest state that the log (file_id, status, seq) has for each."""
    last = log.groupBy(F.col("file_id").alias("id")).agg(F.max_by("status", "seq").alias("_status"))
    return files.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).select(files.columns)


def finished(scans: DataFrame, now: float) -> DataFrame:
    """Scans that were running when the process ended were cancelled by that."""
    lost = F.col("state") == "running"
    return scans.withColumns({
        "finished_at": F.when(lost, F.coalesce("finished_at", F.lit(now))).otherwise(F.col("finished_at")),
        "error": F.when(lost, F.coalesce("error", F.lit("interrupted by a restart"))).otherwise(F.col("error")),
        "state": F.when(lost, F.lit("cancelled")).otherwise(F.col("state")),
    })


def unchanged(dirs: DataFrame, known_dirs: DataFrame) -> DataFrame:
    """(path) of the folders whose time of change is that of the scan before."""
    before = known_dirs.select("path", F.col("mtime").alias("_mtime"))
    return dirs.join(before, "path").filter(same_time(F.col("mtime"), F.col("_mtime"))).select("path").distinct()


def carry_over(dirs: DataFrame, known_dirs: DataFrame, known_files: DataFrame, found: DataFrame, scan_id: int) -> DataFrame:
    """A quick rescan's catalogue.

    Folders whose time of change is that of the scan before keep its present
    files; of all others the files ``found`` count.
    """
    same = unchanged(dirs, known_dirs).withColumnRenamed("path", "parent")
    kept = known_files.filter("status = 'present'").join(same, "parent", "left_semi").withColumn("scan_id", F.lit(scan_id).cast("long"))
    fresh = found.join(same, "parent", "left_anti").withColumn("scan_id", F.lit(scan_id).cast("long"))
    cols = [c for c in found.columns if c in known_files.columns]
    return kept.select(*cols).unionByName(fresh.select(*cols)).dropDuplicates(["scan_id", "path"])


def prune_plan(scans: DataFrame, keep: int = 3) -> DataFrame:
    """(id, doomed): the ``keep`` latest scans stay."""
    stay = scans.select("id").orderBy(F.desc("id")).limit(max(0, keep)).withColumn("_stay", F.lit(True))
    return scans.select("id").join(stay, "id", "left").select("id", F.col("_stay").isNull().alias("doomed"))


def prune_report(scans: DataFrame, files: DataFrame, groups: DataFrame, keep: int = 3) -> DataFrame:
    """(scans, files, groups) that pruning removes."""
    gone = prune_plan(scans, keep).filter("doomed").select(F.col("id").alias("scan_id"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    rows = n(gone, "scans").unionByName(n(files.join(gone, "scan_id", "left_semi"), "files")).unionByName(n(groups.join(gone, "scan_id", "left_semi"), "groups"))
    return rows.agg(*(F.max(F.when(F.col("what") == x, F.col("n"))).alias(x) for x in ("scans", "files", "groups")))


def stale(cache: DataFrame, there: DataFrame) -> DataFrame:
    """(path) of cached versions whose path is not among the existing ones."""
    return cache.select("path").distinct().join(there.select("path"), "path", "left_anti")
