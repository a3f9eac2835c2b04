"""What to do with files: plans as tables, and the one place that carries them out.

A plan says for each requested file what would happen and why, by joins alone.
:func:`apply_plan` runs on the driver, where side effects happen once and not in
tasks that may be tried again; a rehearsal stops short of the file system and is
logged under a name that can never be restored.
"""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorlake.functions import paths
from mirrorlake.options import TRASH, ScanOptions

SIMULATED = "simulate:"
MODES = ("quarantine", "recycle", "permanent", "link")
LOG = "scan_id long, file_id long, action string, src_path string, dst_path string, size long, ok boolean, message string, created_at double"


def last_copies(requested: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, group_id): files to keep since all present members of a group are requested, the least id of each.

    A file that is kept for several groups has one row, with the least group.
    """
    asked = requested.select("file_id").distinct().withColumn("asked", F.lit(True))
    touched = members.join(asked, "file_id", "left_semi").select("group_id").distinct()
    rows = members.select("group_id", "file_id").join(touched, "group_id", "left_semi").join(files.filter("status = 'present'").select(F.col("id").alias("file_id")), "file_id", "left_semi").join(asked, "file_id", "left")
    keep = rows.groupBy("group_id").agg(F.min("file_id").alias("file_id"), F.bool_and(F.coalesce("asked", F.lit(False))).alias("all_asked"))
    return keep.filter("all_asked").groupBy("file_id").agg(F.min("group_id").alias("group_id"))


def twins(requested: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, twin_id): the least present member of a requested file's groups that isn't requested itself."""
    asked = requested.select("file_id").distinct()
    free = members.select("group_id", "file_id").join(asked, "file_id", "left_anti").join(files.filter("status = 'present'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    least = free.groupBy("group_id").agg(F.min("file_id").alias("twin_id"))
    return members.select("group_id", "file_id").join(asked, "file_id", "left_semi").join(least, "group_id").groupBy("file_id").agg(F.min("twin_id").alias("twin_id"))


def quarantine_target(path: Column, root: Column, scan_id: Column) -> Column:
    """``root/<trash>/scan-N/`` and the path below the root."""
    return F.concat(F.rtrim(root, F.lit("/")), F.lit(f"/{TRASH}/scan-"), scan_id.cast("string"), F.lit("/"), paths.below(path, root))


def recycle_target(path: Column, roots: Iterable[str]) -> Column:
    """``share/#recycle/`` and the path below the share; null outside all roots."""
    share = paths.share_root(path, list(roots))
    return F.concat(share, F.lit("/#recycle/"), paths.below(path, share))


def unique_targets(plan: DataFrame, target: str = "dst_path") -> DataFrame:
    """Targets that occur more than once in a plan get .1, .2 ... before their ending, by file id."""
    nth = F.row_number().over(Window.partitionBy(target).orderBy("file_id")) - 1
    ext = paths.extension(paths.basename(target))
    base = F.substring(F.col(target), F.lit(1), F.length(target) - F.length(ext))
    return plan.withColumn("_nth", nth).withColumn(target, F.when(F.col("_nth") == 0, F.col(target)).otherwise(F.concat(base, F.lit("."), F.col("_nth").cast("string"), ext))).drop("_nth")


def _asked(requested: DataFrame, files: DataFrame) -> DataFrame:
    cols = [F.col("id").alias("file_id"), "scan_id", "path", "size", "status", "dev", "inode", "md5"]
    return requested.select("file_id").distinct().join(files.select(*cols), "file_id", "left")


def delete_plan(requested: DataFrame, members: DataFrame, files: DataFrame, scans: DataFrame, o: ScanOptions, mode: str | None = None, gone: DataFrame | None = None) -> DataFrame:
    """(file_id, scan_id, path, size, outcome, message, dst_path) for each requested file.

    In this order: unknown ids fail; files not present, last copies and, after
    paths outside the roots, which fail, files that ``gone`` (file_id) lists are
    skipped; all others are deleted, moved to ``dst_path`` or linked to it.
    """
    mode = mode or o.delete_mode
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "link":
        return link_plan(requested, members, files, o)
    rows = _asked(requested, files).join(scans.select(F.col("id").alias("scan_id"), "root"), "scan_id", "left")
    kept = last_copies(requested, members, files) if o.protect_last_copy else requested.select("file_id", F.lit(None).cast("long").alias("group_id")).limit(0)
    rows = rows.join(kept.withColumnRenamed("group_id", "kept_for"), "file_id", "left")
    missing = gone.select("file_id", F.lit(True).alias("gone")) if gone is not None else requested.select("file_id", F.lit(True).alias("gone")).limit(0)
    rows = rows.join(missing.distinct(), "file_id", "left")
    target = {"quarantine": quarantine_target(F.col("path"), F.col("root"), F.col("scan_id")), "recycle": recycle_target(F.col("path"), o.roots)}.get(mode, F.lit(None).cast("string"))
    cases = [
        (F.col("path").isNull(), "failed", F.lit("unknown id")),
        (F.col("status") != "present", "skipped", F.concat(F.lit("already "), F.col("status"))),
        (F.col("kept_for").isNotNull(), "skipped", F.concat(F.lit("last copy of group "), F.col("kept_for").cast("string"))),
        (~paths.allowed("path", o.roots), "failed", F.lit("outside the roots")),
        (F.col("gone").isNotNull(), "skipped", F.lit("no longer there")),
        *([(target.isNull(), "failed", F.lit("no place to move it to"))] if mode != "permanent" else []),
    ]
    return _decided(rows, cases, target)


def _decided(rows: DataFrame, cases: list[tuple[Column, str, Column]], target: Column) -> DataFrame:
    outcome, message = F.lit("deleted"), F.lit(None).cast("string")
    for test, what, why in reversed(cases):
        outcome, message = F.when(test, what).otherwise(outcome), F.when(test, why).otherwise(message)
    rows = rows.withColumns({"outcome": outcome, "message": message})
    return rows.select("file_id", "scan_id", "path", "size", "outcome", "message", F.when(F.col("outcome") == "deleted", target).alias("dst_path"))


def link_plan(requested: DataFrame, members: DataFrame, files: DataFrame, o: ScanOptions) -> DataFrame:
    """Like :func:`delete_plan`, for replacing files by hard links to a twin, ``dst_path``.

    Skipped without a twin, across devices, for one and the same file, and where
    sizes or hashes differ.
    """
    twin = files.select(F.col("id").alias("twin_id"), F.col("path").alias("t_path"), F.col("dev").alias("t_dev"), F.col("inode").alias("t_inode"), F.col("size").alias("t_size"), F.col("md5").alias("t_md5"))
    rows = _asked(requested, files).join(twins(requested, members, files), "file_id", "left").join(twin, "twin_id", "left")
    cases = [
        (F.col("path").isNull(), "failed", F.lit("unknown id")),
        (F.col("status") != "present", "skipped", F.concat(F.lit("already "), F.col("status"))),
        (F.col("twin_id").isNull(), "skipped", F.lit("no other copy to point at")),
        (~(paths.allowed("path", o.roots) & paths.allowed("t_path", o.roots)), "failed", F.lit("outside the roots")),
        (F.col("dev") != F.col("t_dev"), "skipped", F.lit("on another volume")),
        (F.col("inode") == F.col("t_inode"), "skipped", F.lit("one file already")),
        (F.col("size") != F.col("t_size"), "skipped", F.lit("sizes differ")),
        (~F.col("md5").eqNullSafe(F.col("t_md5")), "skipped", F.lit("contents differ")),
    ]
    return _decided(rows, cases, F.col("t_path"))


def outcome_totals(plan: DataFrame) -> DataFrame:
    """(outcome, files, bytes) of a plan; the bytes of "deleted" are what it frees."""
    return plan.groupBy("outcome").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def restorable(actions: DataFrame) -> DataFrame:
    """Log rows that can be undone: done, moved somewhere, no rehearsal."""
    return actions.filter("ok and dst_path is not null and not startswith(action, 'simulate:')")


def offered(actions: DataFrame) -> DataFrame:
    """What a list offers to restore: :func:`restorable` but for restores themselves."""
    return restorable(actions).filter("action <> 'restore'")


def restore_plan(actions: DataFrame, requested: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """(action_id, file_id, src_path, dst_path, outcome, message) to move files back.

    ``there`` (path) are the paths that exist; what was moved must, and where it
    came from must not. Without it only the log decides.
    """
    rows = restorable(actions).join(requested.select(F.col("action_id").alias("id")).distinct(), "id", "left_semi")
    rows = rows.select(F.col("id").alias("action_id"), "scan_id", "file_id", "size", F.col("action").alias("was"), F.col("dst_path").alias("src_path"), F.col("src_path").alias("dst_path"))
    outcome, message = F.lit("restored"), F.lit(None).cast("string")
    if there is not None:
        side = lambda c: there.select(F.col("path").alias(c + "_path"), F.lit(True).alias(c)).distinct()
        rows = rows.join(side("src"), "src_path", "left").join(side("dst"), "dst_path", "left")
        lost, taken = F.col("src").isNull(), F.col("dst").isNotNull()
        outcome = F.when(lost | taken, "failed").otherwise(outcome)
        message = F.when(lost, "what was moved is gone").when(taken, "the old place is taken")
    return rows.select("action_id", "scan_id", "file_id", "size", "was", "src_path", "dst_path", outcome.alias("outcome"), message.alias("message"))


def emptied(files: DataFrame, scan_id: int) -> DataFrame:
    """(file_id, status) of the status changes when a scan's quarantine is emptied."""
    return files.filter((F.col("scan_id") == scan_id) & (F.col("status") == "quarantined")).select(F.col("id").alias("file_id"), F.lit("deleted").alias("status"))


def free_name(path: str) -> str:
    """``path``, or with .1 to .9999 before its ending where it is taken."""
    if not os.path.lexists(path):
        return path
    base, ext = os.path.splitext(path)
    return next((p for i in range(1, 10_000) if not os.path.lexists(p := f"{base}.{i}{ext}")), f"{base}.{time.time_ns()}{ext}")


def _move(src: str, dst: str) -> str:
    dst = free_name(dst)
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    return shutil.move(src, dst)


def _same(a: str, b: str) -> bool:
    with open(a, "rb") as f, open(b, "rb") as g:
        while True:
            x, y = f.read(1 << 20), g.read(1 << 20)
            if x != y:
                return False
            if not x:
                return True


def _link(path: str, twin: str) -> str:
    """A hard link under another name takes the file's place, which is never empty."""
    s, d = os.stat(twin), os.stat(path)
    if (s.st_dev, s.st_ino) == (d.st_dev, d.st_ino) or s.st_dev != d.st_dev or s.st_size != d.st_size or not _same(path, twin):
        raise OSError("not two copies on one volume")
    new = f"{path}.{os.getpid()}.link"
    os.link(twin, new)
    try:
        os.replace(new, path)
    except OSError:
        os.remove(new)
        raise
    return twin


def apply_plan(plan: DataFrame, mode: str, dry_run: bool = True) -> tuple[list[tuple], dict[int, str]]:
    """Carry out the "deleted" rows of a plan. Returns log rows (:data:`LOG`) and new states by file id.

    Rows come to the driver a partition at a time. Each path is resolved first
    and its parent must not have become a link elsewhere.
    """
    log, states = [], {}
    for r in plan.filter("outcome = 'deleted'").orderBy("file_id").toLocalIterator():
        row = lambda action, dst, ok, message: (r.scan_id, r.file_id, action, r.path, dst, r.size, ok, message, time.time())  # noqa: B023, E731
        if dry_run:
            log.append(row(SIMULATED + mode, r.dst_path, True, "rehearsed"))
            continue
        if not os.path.isfile(r.path):
            states[r.file_id] = "missing"
            continue
        try:
            if os.path.realpath(r.path) != os.path.normpath(r.path):
                raise OSError("path leads elsewhere")
            do: dict[str, Callable[[], str | None]] = {"permanent": lambda: os.remove(r.path), "link": lambda: _link(r.path, r.dst_path)}  # noqa: B023
            if mode == "recycle" and not os.path.isdir(r.dst_path.split("/#recycle/")[0] + "/#recycle"):
                raise OSError("no recycle folder")
            dst = do.get(mode, lambda: _move(r.path, r.dst_path))()  # noqa: B023
        except OSError as e:
            log.append(row(mode, None, False, str(e)))
            continue
        states[r.file_id] = {"permanent": "deleted", "link": "linked"}.get(mode, "quarantined")
        log.append(row(mode, dst, True, None))
    return log, states


def apply_restore(plan: DataFrame) -> tuple[list[tuple], dict[int, str], list[tuple[int, str]]]:
    """Move files back. Returns log rows, new states, and what failed with its reason."""
    log, states, failed = [], {}, []
    for r in plan.filter("outcome = 'restored'").orderBy("action_id").toLocalIterator():
        try:
            if not os.path.isfile(r.src_path):
                raise OSError("what was moved is gone")
            if os.path.lexists(r.dst_path):
                raise OSError("the old place is taken")
            _move(r.src_path, r.dst_path)
        except OSError as e:
            failed.append((r.action_id, str(e)))
            continue
        if r.file_id is not None:
            states[r.file_id] = "present"
        log.append((r.scan_id, r.file_id, "restore", r.src_path, r.dst_path, r.size, True, f"undid {r.was}", time.time()))
    return log, states, failed


def apply_empty(root: str, scan_id: int) -> int:
    """Remove a scan's quarantine; returns how many files were in it."""
    trash = os.path.join(root, TRASH, f"scan-{scan_id}")
    n = sum(len(names) for _, _, names in os.walk(trash))
    if os.path.isdir(trash):
        shutil.rmtree(trash)
    return n


def log_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, LOG)
