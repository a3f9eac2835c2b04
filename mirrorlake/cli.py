"""The command line: scan, report, groups, folders, suggest, delete, restore, empty, log, usage, prune."""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.functions import paths
from mirrorlake.operators import actions, folders, results, suggest
from mirrorlake.operators.lineage import cut
from mirrorlake.operators.store import Store
from mirrorlake.options import ScanOptions
from mirrorlake.plans import scan as scans
from mirrorlake.sources import walker


def _print(df: DataFrame) -> None:
    """At most a screen of rows: every report here has a limit of its own."""
    df.show(500, truncate=False)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mirrorlake")
    top.add_argument("--store", default="mirrorlake-store", help="folder of the tables")
    top.add_argument("--root", action="append", default=[], help="folder that may be read and changed; may be repeated")
    top.add_argument("--config", help="JSON file of options; made with the defaults if it isn't there")
    top.add_argument("--shared", help="folder that all executors see, for what is kept between jobs; else spark.checkpoint.dir")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("scan")
    one.add_argument("path")
    one.add_argument("--no-near", action="store_true")
    one.add_argument("--no-verify", action="store_true")
    one.add_argument("--quick-rescan", action="store_true")
    one.add_argument("--threshold", type=int, default=70)
    one.add_argument("--min-size", type=int, default=1)
    for name in ("report", "groups", "folders", "suggest", "log"):
        p = sub.add_parser(name)
        p.add_argument("--scan", type=int)
        p.add_argument("--limit", type=int, default=20)
        if name == "groups":
            for flag in ("kind", "q", "sort", "dir", "min-similarity", "min-size", "offset", "suggested-only"):
                p.add_argument("--" + flag)
        if name == "suggest":
            p.add_argument("ids", type=int, nargs="*", help="groups; all without")
            p.add_argument("--engine", choices=("auto", "ai", "heuristic"), default="auto")
            p.add_argument("--provider", help="module:name of a SuggestionProvider")
    p = sub.add_parser("delete")
    p.add_argument("ids", type=int, nargs="+")
    p.add_argument("--mode", choices=actions.MODES)
    p.add_argument("--confirm", action="store_true", help="without, it is a rehearsal")
    p = sub.add_parser("restore")
    p.add_argument("ids", type=int, nargs="+", help="of the log")
    p = sub.add_parser("empty")
    p.add_argument("scan", type=int)
    sub.add_parser("usage")
    p = sub.add_parser("prune")
    p.add_argument("--keep", type=int, default=3)
    p.add_argument("--keep-cache", action="store_true", help="also of files that are no longer there")
    p.add_argument("--compact", action="store_true")
    return top


def _append_log(store: Store, rows: list[tuple]) -> None:
    if rows:
        first = store.next_id("actions")
        made = [(first + i, *r) for i, r in enumerate(rows)]
        store.append("actions", store.spark.createDataFrame(made, "id long, " + actions.LOG))


def delete(store: Store, ids: Sequence[int], o: ScanOptions, mode: str | None = None, dry_run: bool = True) -> DataFrame:
    """Plan, carry out and log; returns the plan."""
    mode = mode or o.delete_mode
    asked = store.spark.createDataFrame([(i,) for i in ids], "file_id long")
    plan = actions.delete_plan(asked, store.read("group_members"), store.files(), store.read("scans"), o, mode).cache()
    log, states = actions.apply_plan(plan, mode, dry_run)
    store.set_states(states)
    _append_log(store, log)
    return plan


def restore(store: Store, ids: Sequence[int]) -> list[tuple[int, str]]:
    """Undo log entries; returns what failed with its reason."""
    asked = store.spark.createDataFrame([(i,) for i in ids], "action_id long")
    log, states, failed = actions.apply_restore(actions.restore_plan(store.read("actions"), asked))
    store.set_states(states)
    _append_log(store, log)
    return failed


def empty(store: Store, scan_id: int) -> int:
    """Remove a scan's quarantine; returns how many files went."""
    row = store.read("scans").filter(F.col("id") == scan_id).first()
    if row is None:
        raise ValueError("unknown scan")
    changed = [r.file_id for r in actions.emptied(store.files(), scan_id).collect()]  # those of one scan's quarantine
    n = actions.apply_empty(row.root, scan_id)
    store.set_states(dict.fromkeys(changed, "deleted"))
    return n


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if spark is None:
        made = SparkSession.builder.appName("mirrorlake").config("spark.sql.session.timeZone", "UTC")
        spark = (made.config("spark.checkpoint.dir", a.shared) if a.shared else made).getOrCreate()
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise SystemExit("on a cluster, name a folder that all executors see: --shared or spark.checkpoint.dir")
    store, o = Store(spark, a.store), ScanOptions.load(a.config) if a.config else ScanOptions()
    if a.root:
        o = o.updated({"roots": tuple(a.root)})
    now = time.time()
    if a.command == "scan":
        scans.recover(store)
        o = o.updated({"near_duplicates": not a.no_near, "verify_bytes": not a.no_verify, "quick_rescan": a.quick_rescan, "near_threshold": a.threshold, "min_size": a.min_size})
        n = scans.run(store, a.path, o, scans.Progress(lambda s: print(f"{s['nth']}/{s['of']} {s['phase']}")))
        _print(store.read("scans").filter(F.col("id") == n).select("id", "state", "files_seen", paths.human_bytes("bytes_seen").alias("bytes"), "groups_found", paths.human_bytes("wasted_bytes").alias("wasted")))
        return 0
    if a.command == "usage":
        _print(results.usage({t: store.read(t) for t in ("scans", "files", "groups", "group_members", "suggestions", "actions", "hash_cache", "dir_cache", "verify_cache")}))
        _print(results.usage_by_scan(store.read("scans"), store.read("files"), store.read("groups")).limit(50))
        return 0
    if a.command == "prune":
        there = None if a.keep_cache else walker.existing(store.read("hash_cache"))
        print(store.prune(a.keep, there))
        if a.compact:
            store.compact()
        return 0
    if a.command == "delete":
        _print(actions.outcome_totals(delete(store, a.ids, o, a.mode, not a.confirm)))
        return 0
    if a.command == "restore":
        for i, why in restore(store, a.ids):
            print(i, why)
        return 0
    if a.command == "empty":
        print(empty(store, a.scan), "files removed")
        return 0
    which = results.latest_scan(store.read("scans"), a.scan).first()
    if which is None:
        print("no scan yet")
        return 1
    own = lambda name: store.read(name).filter(F.col("scan_id") == which.id)
    files, groups, said = store.files(which.id), own("groups"), own("suggestions")
    members = store.read("group_members").join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    if a.command == "report":
        top = results.report_top(groups, said, a.limit)
        _print(top.select("id", "kind", "label", "file_count", paths.human_bytes("wasted_bytes").alias("wasted"), "summary", "confidence"))
        _print(results.group_members(members.join(top.select(F.col("id").alias("group_id")), "group_id", "left_semi"), files, said).select("group_id", "path", "size", "action"))
    elif a.command == "groups":
        flags = {k: v for k in ("kind", "q", "sort", "dir", "min_similarity", "min_size", "offset", "suggested_only") if (v := getattr(a, k)) is not None}
        _print(results.groups_page(groups, members, files, said, results.GroupParams.of({**flags, "limit": a.limit})))
    elif a.command == "folders":
        _print(folders.folder_report(members, files, a.limit))
    elif a.command == "suggest":
        provider = None
        if a.provider:
            module, _, name = a.provider.partition(":")
            provider = getattr(importlib.import_module(module), name)()
        made = cut(suggest.suggest(groups, members, files, now, o, a.engine, provider, a.ids))
        store.replace("suggestions", suggest.upserted(store.read("suggestions"), made))
        _print(suggest.progress(groups, own("suggestions")))
        _print(store.read("suggestions").filter(F.col("scan_id") == which.id).select("group_id", "summary", "merge_plan", "confidence").limit(a.limit))
    elif a.command == "log":
        _print(results.action_log(store.read("actions"), which.id, a.limit))
    return 0
