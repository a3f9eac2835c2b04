"""Real folders: walking, a whole scan, actions and restores, rescans, pruning, the command line, streams."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from mirrorlake import cli
from mirrorlake.operators import actions, lineage, suggest
from mirrorlake.operators.store import Store
from mirrorlake.options import ScanOptions
from mirrorlake.plans import scan
from mirrorlake.sources import walker
from mirrorlake.streaming import exact as stream


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def xorshift(n, x=0x2545F491):
    out = bytearray()
    for _ in range(n):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out.append(x & 255)
    return bytes(out)


@pytest.fixture
def tree(tmp_path):
    """Three equal files and one much like them, two equal ones that are periodic, one alone."""
    root, r = tmp_path / "tree", random.Random(5)
    report = xorshift(300_000)
    for p in ("a/report.bin", "b/sub/report copy.bin", "c/report (1).bin"):
        put(root / p, report)
    put(root / "b/report_edited.bin", report[:-5000] + r.randbytes(5000))
    put(root / "a/notes.txt", b"hello world " * 5000)
    put(root / "c/notes-backup.txt", b"hello world " * 5000)
    put(root / "a/unique.bin", r.randbytes(100_000))
    return root


def test_walk(spark, tree, tmp_path):
    put(tree / ".git/x", b"1")
    put(tree / "a/half.part", b"1")
    put(tree / "a/empty", b"")
    os.link(tree / "a/unique.bin", tree / "c/another name.bin")
    os.symlink(tree, tree / "c/loop")
    os.symlink(tree / "a/notes.txt", tree / "top.txt")
    names = sorted(os.path.relpath(r.path, tree) for r in walker.tree(spark, str(tree)).collect())
    assert names == ["a/notes.txt", "a/report.bin", "a/unique.bin", "b/report_edited.bin", "b/sub/report copy.bin", "c/notes-backup.txt", "c/report (1).bin"]
    followed = {os.path.relpath(r.path, tree) for r in walker.tree(spark, str(tree), ScanOptions(follow_symlinks=True, min_size=90_000)).collect()}
    assert "a/report.bin" in followed and not any("notes" in p for p in followed)
    assert {os.path.relpath(r.path, tree) for r in walker.folders(spark, str(tree)).collect()} == {".", "a", "b", "b/sub", "c"}
    with pytest.raises(PermissionError):
        walker.tree(spark, str(tree), ScanOptions(roots=(str(tmp_path / "other"),)))
    lost = spark.createDataFrame([(str(tree / "gone"), 5)], "path string, size long")
    assert walker.hashed(lost, "md5").first().md5 is None


def test_scan_delete_restore_rescan_prune(spark, tree, tmp_path, capsys):
    store, o = Store(spark, str(tmp_path / "store")), ScanOptions(roots=(str(tree),))
    phases = []
    assert scan.run(store, str(tree), o, scan.Progress(lambda s: phases.append(s["phase"]))) == 1
    assert phases == list(scan.PHASES)
    groups = {(r.kind, r.label): (r.file_count, r.wasted_bytes, r.verified) for r in store.read("groups").collect()}
    assert {(k, *v) for (k, _), v in groups.items()} == {("exact", 3, 600_000, True), ("exact", 2, 60_000, True), ("near", 2, 300_000, False)}
    row = store.read("scans").first()
    assert (row.state, row.files_seen, row.groups_found, row.wasted_bytes) == ("done", 7, 3, 960_000)

    said = [(int(k), v.action) for r in store.read("suggestions").collect() for k, v in r.verdicts.items()]
    doomed = [i for i, a in said if a == "delete"]
    assert len(doomed) == 2
    cli.delete(store, doomed, o)
    assert all(os.path.exists(tree / p) for p in ("b/sub/report copy.bin", "c/report (1).bin", "a/report.bin"))
    assert actions.offered(store.read("actions")).count() == 0
    cli.delete(store, doomed, o, dry_run=False)
    assert sum(os.path.exists(tree / p) for p in ("b/sub/report copy.bin", "c/report (1).bin", "a/report.bin")) == 1
    assert store.files().groupBy("status").count().orderBy("status").collect()[1].asDict() == {"status": "quarantined", "count": 2}
    done = [r.id for r in actions.offered(store.read("actions")).collect()]
    assert store.read("actions").count() == 4 and len(done) == 2
    put(tree / "c/report (1).bin", b"in the way")
    failed = cli.restore(store, done)
    assert len(failed) == 1 and os.path.exists(tree / "b/sub/report copy.bin")

    # an edited file doesn't keep its old hash; unchanged folders are carried over
    put(tree / "a/notes.txt", b"hello World " * 5000)
    os.utime(tree / "a/notes.txt", (1, 1))
    assert scan.run(store, str(tree), o.updated({"near_duplicates": False})) == 2
    assert not [r for r in store.read("groups").filter("scan_id = 2").collect() if r.max_size == 60_000]
    n = store.files(2).count()
    assert scan.run(store, str(tree), o.updated({"near_duplicates": False, "quick_rescan": True})) == 3
    assert store.files(3).count() == n

    for argv in (["report"], ["groups", "--q", "report", "--kind", "exact"], ["folders"], ["suggest"], ["log", "--scan", "1"], ["usage"]):
        assert cli.main(["--store", store.root, "--root", str(tree), *argv], spark) == 0
    assert "report" in capsys.readouterr().out
    gone = store.prune(1, store.files(3).select("path"))
    assert gone["scans"] == 2 and store.read("scans").count() == 1 and store.read("groups").filter("scan_id < 3").count() == 0
    store.compact()
    assert cli.empty(store, 3) == 0
    with pytest.raises(ValueError):
        cli.empty(store, 77)


def picture(seed):
    """A PNG of 32 x 32 in shades of grey."""
    import struct
    import zlib

    r = random.Random(seed)
    rows = b"".join(b"\0" + bytes(r.randrange(256) for _ in range(32)) for _ in range(32))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 32, 32, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_rescans_read_nothing_twice(spark, tree, tmp_path):
    """Caches go by size and time: contents changed behind their back are not seen, so nothing was read again."""
    for i in range(2):
        put(tree / f"pics/{i}.png", picture(i) + b" " * 200)
    store, o = Store(spark, str(tmp_path / "store")), ScanOptions(roots=(str(tree),), fuzzy_min_size=192)
    scan.run(store, str(tree), o)
    assert store.read("verify_cache").filter("same").count() == 3  # two of three files and one of two, each beside the first; none of the near pair
    assert store.read("hash_cache").filter("dhash is not null").count() == 2
    for name in ("b/sub/report copy.bin", "pics/1.png"):
        st = os.stat(tree / name)
        data = bytearray((tree / name).read_bytes())
        data[60] ^= 255
        (tree / name).write_bytes(data)
        os.utime(tree / name, ns=(st.st_atime_ns, st.st_mtime_ns))
    scan.run(store, str(tree), o)
    known = store.read("groups").filter("scan_id = 2 and kind = 'exact'").collect()
    assert sorted((r.file_count, r.verified) for r in known) == [(2, True), (3, True)]
    assert store.read("verify_cache").count() == 3
    hashes = {(r.scan_id, r.name): r.dhash for r in store.read("files").filter("ext = '.png'").collect()}
    assert hashes[1, "1.png"] == hashes[2, "1.png"] is not None

    # a quick rescan doesn't even look at the files of unchanged folders
    before = os.stat(tree / "a")
    (tree / "a/unique.bin").write_bytes(b"short")
    assert os.stat(tree / "a").st_mtime_ns == before.st_mtime_ns
    put(tree / "c/new.bin", b"new" * 100)
    scan.run(store, str(tree), o.updated({"quick_rescan": True, "near_duplicates": False}))
    sizes = {r.name: r.size for r in store.files(3).collect()}
    assert sizes["unique.bin"] == 100_000 and sizes["new.bin"] == 300
    scan.run(store, str(tree), o.updated({"near_duplicates": False}))
    assert {r.name: r.size for r in store.files(4).collect()}["unique.bin"] == 5

    os.remove(tree / "c/new.bin")
    assert cli.main(["--store", store.root, "prune", "--keep", "2"], spark) == 0
    left = {os.path.basename(r.path) for r in store.read("hash_cache").collect()}
    assert "new.bin" not in left and "report.bin" in left


def test_folders_linked_from_several_branches(spark, tmp_path):
    put(tmp_path / "outside/x/deep.bin", b"1")
    for name in ("a", "b"):
        (tmp_path / "tree" / name).mkdir(parents=True)
        os.symlink(tmp_path / "outside", tmp_path / "tree" / name / "link")
    o = ScanOptions(follow_symlinks=True)
    found = [os.path.relpath(r.path, tmp_path) for r in walker.tree(spark, str(tmp_path / "tree"), o).collect()]
    assert found == ["tree/a/link/x/deep.bin"]


def test_a_tree_of_one_branch_is_shared_out(tmp_path):
    for i in range(9):
        put(tmp_path / f"only/one/{i}/f", b"1")
    parts = walker._Walk({"path": str(tmp_path)}).partitions()
    assert len(parts) == 12 and len({p.path for p in parts}) == 12


def test_engine_start_options_and_suggestions(spark, tree, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    store.append("scans", spark.createDataFrame([(1, "/r", "running"), (2, "/r", "done")], "id long, root string, state string"))
    scan.recover(store, 7.0)
    rows = {r.id: r for r in store.read("scans").collect()}
    assert (rows[1].state, rows[1].finished_at, rows[2].state) == ("cancelled", 7.0, "done") and rows[1].error
    at = str(tmp_path / "conf/options.json")
    assert ScanOptions.load(at) == ScanOptions() and os.path.exists(at)
    ScanOptions(min_size=5, roots=("/x",)).save(at)
    assert ScanOptions.load(at) == ScanOptions(min_size=5, roots=("/x",))
    for bad in ("{", "[1]", '{"min_size": "x"}', '{"unknown": 1}'):
        (tmp_path / "conf/options.json").write_text(bad)
        assert ScanOptions.load(at) == ScanOptions()
    scan.run(store, str(tree), ScanOptions(near_duplicates=False))
    said = store.read("suggestions").filter("scan_id = 3")
    one = said.first().group_id
    own = lambda n: store.read(n).filter("scan_id = 3")
    args = own("groups"), store.read("group_members"), store.files(3), 9.0
    again = suggest.suggest(*args, ids=[one])
    assert [r.group_id for r in again.collect()] == [one]
    both = suggest.upserted(said, again)
    assert both.count() == said.count() == 2 and both.filter("created_at = 9").count() == 1
    assert suggest.progress(own("groups"), again).first().asDict() == {"scan_id": 3, "todo": 2, "done": 1, "by_ai": 0, "by_heuristic": 1, "sure": 1}
    for engine in ("ai", "other"):
        with pytest.raises(ValueError):
            suggest.suggest(*args, engine=engine)
    assert cli.main(["--store", store.root, "suggest", str(one), "--engine", "heuristic"], spark) == 0


def test_copies_between_jobs_are_removed(spark):
    """Once nothing refers to them any more, the driver's garbage collection takes them off the disk."""
    import gc
    import time

    at = lineage.shared_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(at) for f in names}
    before = files()
    df = lineage.cut(spark.range(100))
    kept = lineage.cut(df.filter("id > 5"))
    assert files() - before
    del df
    for _ in range(40):
        gc.collect()
        spark._jvm.System.gc()
        if len({p.split("/rdd-")[1].split("/")[0] for p in files() - before}) <= 1:
            break
        time.sleep(0.5)
    assert len({p.split("/rdd-")[1].split("/")[0] for p in files() - before}) == 1
    assert kept.count() == 94


def test_links_and_permanent(spark, tree, tmp_path):
    rows = [(1, 1, str(tree / "c/report (1).bin"), 300_000, "deleted", None, str(tree / "a/report.bin")), (2, 1, str(tree / "a/unique.bin"), 100_000, "deleted", None, str(tree / "a/report.bin")), (3, 1, str(tree / "gone"), 1, "deleted", None, None)]
    plan = spark.createDataFrame(rows, "file_id long, scan_id long, path string, size long, outcome string, message string, dst_path string")
    log, states = actions.apply_plan(plan, "link", dry_run=False)
    assert states == {1: "linked", 3: "missing"} and [r[6] for r in log] == [True, False]
    assert os.stat(tree / "c/report (1).bin").st_ino == os.stat(tree / "a/report.bin").st_ino
    log, states = actions.apply_plan(plan.filter("file_id = 2"), "permanent", dry_run=False)
    assert states == {2: "deleted"} and not os.path.exists(tree / "a/unique.bin")
    put(tree / "x", b"1")
    put(tree / "x.1", b"1")
    assert actions.free_name(str(tree / "x")) == str(tree / "x.2")
    log, _ = actions.apply_plan(plan.filter("file_id = 1").withColumn("dst_path", F.lit(str(tree / "#recycle/z"))), "recycle", dry_run=False)
    assert log[0][6] is False  # there is no recycle folder


def test_failures_and_cancelling_are_kept(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    progress = scan.Progress()
    progress.cancel()
    assert scan.run(store, str(tree), progress=progress) == 1
    assert store.read("scans").first().state == "cancelled"


def test_streams(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, f"/s/{i % 3}", f"f{i}", bytearray(b"c%d" % (i % 4)), ts + datetime.timedelta(minutes=i)) for i in range(12)]
    schema = "id long, scan_id long, parent string, name string, content binary, ts timestamp"
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = stream.arriving(spark, f"{tmp_path}/in", schema, 1)
    seen = []
    stream.run_exact(arriving, f"{tmp_path}/table", f"{tmp_path}/cp", lambda n, g: seen.append({r.file_count for r in g.collect()})).awaitTermination(120)
    assert seen == [set(), {2}, {3}]
    for name, df, n in (("first", stream.first_of_each(arriving), 4), ("marked", stream.first_of_each(arriving, "ts"), 4)):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == n
    many = stream.copies_by_window(arriving)
    many.writeStream.format("memory").queryName("many").outputMode("complete").option("checkpointLocation", f"{tmp_path}/many").trigger(availableNow=True).start().awaitTermination(120)
    assert {r.files for r in spark.table("many").collect()} == {3}
