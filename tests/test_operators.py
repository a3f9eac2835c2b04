"""Operators on tables built by hand, and the near pass against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorlake.functions import ctph
from mirrorlake.operators import actions, caches, exact, folders, fuzzy, groups, results, suggest
from mirrorlake.operators.components import components
from mirrorlake.operators.lineage import row_bytes, small
from mirrorlake.options import ScanOptions

NOW = 1_700_000_000.0


def files(spark, rows):
    """Rows of (id, path, content, mtime, status)."""
    made = spark.createDataFrame([(i, p, bytearray(c) if c is not None else None, float(m), s) for i, p, c, m, s in rows], "id long, path string, content binary, mtime double, status string")
    split = F.split("path", "/")
    return made.withColumns({
        "scan_id": F.lit(1).cast("long"), "parent": F.regexp_replace("path", "/[^/]*$", ""), "name": F.element_at(split, -1), "ext": F.regexp_extract("path", r"(\.[^./]*)$", 1),
        "size": F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"), "dev": F.lit(1).cast("long"), "inode": F.col("id"), "nlink": F.lit(1).cast("long"), "md5": F.md5("content"),
    })


def test_cascade_empty_missing_and_equal(spark):
    f = files(spark, [(1, "/r/a", b"xx", 1, "present"), (2, "/r/b", b"xx", 1, "present"), (3, "/r/c", b"xy", 1, "present"), (4, "/r/d", b"", 1, "present"), (5, "/r/e", b"", 1, "present"), (6, "/r/f", None, 1, "present")]).drop("md5")
    got = exact.cascade(f).collect()
    assert sorted((r.size, r.least, r.id, r.verified) for r in got) == [(2, 1, 1, True), (2, 1, 2, True)]
    assert exact.cascade(f, ScanOptions(verify_bytes=False)).first().verified is False
    assert exact.cascade(f.filter("false")).collect() == []
    assert groups.exact_groups(f, exact.verified_clusters(f, verify=False)).first().similarity == 99.0


def serial_components(edges):
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {x: root(x) for x in list(at)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == serial_components(edges)


def test_components_of_a_long_path(spark):
    r = random.Random(1)
    order = r.sample(range(300), 300)
    edges = list(zip(order, order[1:], strict=False))
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.component for x in got} == {0} and len(got) == 300


def test_hamming_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    bits = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(4)]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    for most in (0, 3, 8):
        got = {(x.a, x.b): x.distance for x in fuzzy.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, bits long"), most).collect()}
        want = {(i, j): (bits[i] ^ bits[j]).bit_count() for i in range(len(bits)) for j in range(i + 1, len(bits)) if (bits[i] ^ bits[j]).bit_count() <= most}
        assert got == want


def test_hamming_pairs_meet_at_long_keys_only(spark):
    """Bits that have seven of 64 in common, and equal ones, are no reason to compare everything with everything."""
    r = random.Random(5)
    bits = [r.getrandbits(57) for _ in range(3000)]
    rows = fuzzy.flipped(spark.createDataFrame([(b,) for b in bits], "bits long"), 8)
    assert rows.groupBy("nth", "key").count().agg(F.max("count")).first()[0] < 30
    same = spark.createDataFrame([(i, b) for i, b in enumerate([5] * 30 + [4] * 20 + [None])], "id long, bits long")
    got = [(x.a, x.b, x.distance) for x in fuzzy.hamming_pairs(same).collect()]
    assert sorted(got) == [(i, j, int(i < 30 <= j)) for i in range(50) for j in range(i + 1, 50)]


@pytest.mark.parametrize("parity", [False, True])
def test_near_pairs_equal_all_pairs(spark, parity):
    r = random.Random(3)
    rows, contents = [], {}
    for i in range(40):
        if i % 4 == 0:
            data = r.randbytes(r.randint(300, 9000))
        else:
            data = bytearray(contents[i - i % 4])
            for _ in range(r.choice([1, 3, 10])):
                at = r.randrange(len(data))
                data[at : at + r.randint(0, 5)] = r.randbytes(r.randint(0, 40))
            data = bytes(data) * (2 if r.random() < 0.2 else 1)
        contents[i] = data
        rows.append((i, f"/r/d{i % 3}/report {i}.{'bin' if i % 5 else 'dat'}", data, i, "present"))
    o = ScanOptions(fuzzy_min_size=192, near_threshold=50, parity=parity)
    f = files(spark, rows)
    got = {(x.a, x.b): x.score for x in fuzzy.near_pairs(f, exact.md5_groups(f), o).collect()}
    sigs = {i: ctph.signature(c, None, o.fuzzy_max_bytes) for i, c in contents.items()}
    want = {}
    for i in contents:
        for j in range(i + 1, 40):
            content = ctph.compare(sigs[i], sigs[j], parity)
            if content > 0 and contents[i] != contents[j]:
                x, y = len(contents[i]), len(contents[j])
                score = round(0.8 * content + 12 * min(x, y) / max(x, y) + 8 - (5 if (i % 5 == 0) != (j % 5 == 0) else 0))
                if min(98, score) >= 50:
                    want[i, j] = min(98, score)
    assert len(want) > 10 and got == want


def test_only_texts_whose_letters_allow_it_are_compared(spark, monkeypatch):
    """Texts that share a passage and little else meet at one key; those that reach the threshold are all found."""
    r = random.Random(7)
    letters = ctph.LETTERS.tobytes().decode()
    word = lambda n: "".join(r.choices(letters, k=n))
    passage, base = word(12), word(60)
    texts = [word(26) + passage + word(26) for _ in range(60)] + [base[:k] + word(3) + base[k + 3 :] for k in range(0, 57, 5)] + ["abc"]
    sigs = {i: f"{48 << i % 2}:{t}:{word(30)}" if i % 3 else f"48:{word(64)}:{t[:32]}" for i, t in enumerate(texts)}
    seen = []
    scores = fuzzy.content_scores
    monkeypatch.setattr(fuzzy, "content_scores", lambda pairs, *rest: seen.append(pairs.count()) or scores(pairs, *rest))
    for parity in (False, True):
        o = ScanOptions(parity=parity)
        signed = spark.createDataFrame(list(sigs.items()), "id long, fuzzy string")
        every = {(i, j): ctph.compare(sigs[i], sigs[j], parity) for i in sigs for j in sigs if i < j}
        for least in (1, 40, fuzzy.least_content(o)):
            got = {(x.a, x.b): x.content for x in fuzzy.signature_pairs(signed, o, least).collect()}
            assert got == {p: v for p, v in every.items() if v >= least} and got
        assert seen[-1] < seen[-3] / 3
    assert fuzzy.least_content(ScanOptions()) == 62 and fuzzy.least_content(ScanOptions(near_threshold=99)) == 101


def test_near_members(spark):
    f = files(spark, [(i, f"/r/{i}", b"z" * n, m, "present") for i, n, m in ((1, 10, 5), (2, 20, 9), (3, 20, 7), (4, 5, 1), (7, 9, 1), (8, 9, 1))])
    pairs = spark.createDataFrame([(1, 2, 80), (2, 3, 90), (4, 1, 70), (7, 8, 95)], "a long, b long, score int")
    exact_ids = spark.createDataFrame([(7,), (8,), (1,)], "id long")
    got = {(x.group_id, x.file_id): x.similarity for x in fuzzy.near_members(pairs, f, exact_ids).collect()}
    # 3 is as large as 2 but older; 1 and 4 aren't paired with it
    assert got == {(3, 3): 100.0, (3, 2): 90.0, (3, 1): 0.9 * 90, (3, 4): 0.9 * 90}
    members = fuzzy.near_members(pairs, f, exact_ids, ScanOptions(report_linked_exact=True))
    assert {x.group_id for x in members.collect()} == {3, 15}
    row = groups.group_rows(members.filter("group_id = 3"), f, "near").first()
    assert (row.similarity, row.wasted_bytes, row.label) == (84.0, 35, "1")


def scan_tables(spark):
    f = files(spark, [
        (1, "/r/photo/a.jpg", b"one", 10, "present"), (2, "/r/downloads/a copy.jpg", b"one", 20, "present"), (3, "/r/backup/a.jpg", b"one", 30, "present"),
        (4, "/r/x/b.txt", b"two!", 10, "present"), (5, "/r/y/b.txt", b"two!", 10, "deleted"), (6, "/r/x/c.txt", b"three", 1, "present"), (7, "/r/y/c.txt", b"three", 2, "present"),
    ])
    c = exact.verified_clusters(f)
    m = groups.exact_members(c)
    g = groups.exact_groups(f, c)
    return f, g, m.select("group_id", "file_id", "similarity"), suggest.suggestions(g, m, f, NOW)


def test_suggestions(spark):
    f, g, m, s = scan_tables(spark)
    got = {r.group_id: r for r in s.collect()}
    assert set(got) == {2, 12}  # the second group has one file left
    assert got[2].keep_file_id == 1 and got[2].confidence == 90
    assert {k: v.action for k, v in got[2].verdicts.items()} == {"1": "keep", "2": "delete", "3": "review"}
    assert got[12].keep_file_id == 7  # the newer of equals
    near = g.withColumn("kind", F.lit("near"))
    for o, want in ((ScanOptions(), {"keep", "review"}), (ScanOptions(parity=True), {"keep", "delete", "review"})):
        got = {r.group_id: r for r in suggest.suggestions(near, m, f, NOW, o).collect()}
        assert {v.action for v in got[2].verdicts.values()} == want and got[2].confidence == 55


def test_provider_is_checked(spark):
    f, g, m, _ = scan_tables(spark)

    class Provider:
        def suggest(self, asked):
            if asked[0]["group_id"] == 12:
                raise OSError("offline")
            yield 2, "/r/backup/a.jpg", 400, "s", "p", [("/r/photo/a.jpg", "delete", "why"), ("/r/elsewhere", "delete", ""), ("/r/downloads/a copy.jpg", "explode", "")]
            yield 999, "/r/x", 1, "", "", []

    got = {r.group_id: r for r in suggest.suggestions_by(Provider(), g, m, f, NOW, batch=1).collect()}
    assert (got[2].source, got[2].keep_file_id, got[2].confidence) == ("ai", 3, 100)
    assert {k: v.action for k, v in got[2].verdicts.items()} == {"1": "delete", "2": "review", "3": "keep"}
    assert got[12].source == "heuristic"


def test_last_copies_and_delete_plan(spark):
    f, g, m, _ = scan_tables(spark)
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (7,), (99,)], "file_id long")
    assert {r.file_id: r.group_id for r in actions.last_copies(asked, m, f).collect()} == {1: 2, 4: 8}
    scans = spark.createDataFrame([(1, "/r")], "id long, root string")
    got = {r.file_id: r for r in actions.delete_plan(asked, m, f, scans, ScanOptions(roots=("/r/downloads", "/r/photo", "/r/x", "/r/y"))).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "skipped", 2: "deleted", 3: "failed", 4: "skipped", 5: "skipped", 7: "deleted", 99: "failed"}
    assert got[7].dst_path == "/r/.mirrorlake-trash/scan-1/y/c.txt"
    free = {r.file_id: r.outcome for r in actions.delete_plan(asked, m, f, scans, ScanOptions(protect_last_copy=False), "permanent").collect()}
    assert free[1] == free[4] == "deleted"
    with pytest.raises(ValueError):
        actions.delete_plan(asked, m, f, scans, ScanOptions(), "shred")


def test_link_plan_and_targets(spark):
    f, g, m, _ = scan_tables(spark)
    asked = spark.createDataFrame([(2,), (3,), (4,), (7,)], "file_id long")
    got = {r.file_id: (r.outcome, r.dst_path) for r in actions.link_plan(asked, m, f, ScanOptions()).collect()}
    assert got == {2: ("deleted", "/r/photo/a.jpg"), 3: ("deleted", "/r/photo/a.jpg"), 4: ("skipped", None), 7: ("deleted", "/r/x/c.txt")}
    plan = spark.createDataFrame([(1, "/t/a.txt"), (2, "/t/a.txt"), (3, "/t/b"), (4, "/t/b")], "file_id long, dst_path string")
    assert [r.dst_path for r in actions.unique_targets(plan).orderBy("file_id").collect()] == ["/t/a.txt", "/t/a.1.txt", "/t/b", "/t/b.1"]


def test_group_queries(spark):
    f, g, m, s = scan_tables(spark)
    page = lambda **p: [r.id for r in results.groups_page(g, m, f, s, results.GroupParams(**p)).collect()]
    assert page() == [2, 12] and page(dir="asc") == [12, 2] and page(sort="nonsense") == [2, 12]
    assert page(q="DOWNLOADS") == [2] and page(q="_.jpg") == [2] and page(q="é") == []
    assert page(limit=1, offset=1) == [12] and page(limit=-1) == [2, 12] and page(kind="near") == [] and page(kind="odd") == [2, 12]
    assert page(min_size=4) == [12] and page(min_similarity=100.5) == []
    none = s.filter("group_id = 2")
    order = lambda d: [r.id for r in results.groups_page(g, m, f, none, results.GroupParams(sort="confidence", dir=d)).collect()]
    assert order("asc") == [12, 2] and order("desc") == [2, 12]
    p = results.GroupParams.of({"min_size": ["x"], "limit": ["9"], "min_similarity": ["70"], "suggested_only": "true"})
    assert (p.min_size, p.limit, p.min_similarity, p.suggested_only) == (0, 9, 70.0, True)
    one = results.one_group(g, m, f, s, 2).first()
    assert [x.path for x in one.files] == ["/r/backup/a.jpg", "/r/downloads/a copy.jpg", "/r/photo/a.jpg"] and one.suggestion.keep_file_id == 1
    assert results.one_group(g, m, f, s, 5).collect() == []
    assert results.groups_summary(g.filter("false"), m, f).first().asDict() == {"groups": 0, "wasted": 0, "files": 0}
    meta = results.group_members(m, f, s, with_meta=True).filter("group_id = 2")
    assert all(r.is_image for r in meta.collect()) and "content" not in meta.columns


def test_folder_pairs_equal_all_pairs(spark):
    r = random.Random(4)
    f = files(spark, [(i, f"/f{r.randrange(4)}/{i}", b"q" * r.randint(1, 3), 1, "present") for i in range(40)])
    m = f.select((F.col("id") % 5).alias("group_id"), F.col("id").alias("file_id"))
    rows = f.collect()
    want = {}
    for x in rows:
        for y in rows:
            if x.id < y.id and x.id % 5 == y.id % 5 and x.parent != y.parent:
                n, b = want.get(tuple(sorted((x.parent, y.parent))), (0, 0))
                want[tuple(sorted((x.parent, y.parent)))] = n + 1, b + min(x.size, y.size)
    assert {(p.a, p.b): (p.shared_files, p.shared_bytes) for p in folders.folder_pairs(m, f).collect()} == want


def test_caches(spark):
    log = spark.createDataFrame([("/a", 1, 5.0, "q1", None, None, None, 1.0), ("/a", 1, 5.0, "q2", "m", None, None, 2.0), ("/a", 1, 5.0, None, None, None, 7, 3.0), ("/a", 2, 6.0, "q3", None, None, None, 4.0)], "path string, size long, mtime double, quick string, md5 string, fuzzy string, dhash long, seen_at double")
    cache = caches.hash_upsert(log)
    known = {(r.size): (r.quick, r.md5, r.dhash) for r in cache.collect()}
    assert known == {1: ("q2", "m", 7), 2: ("q3", None, None)}  # an edited file inherits nothing
    rows = spark.createDataFrame([(1, "/a", 1, 5.0005), (2, "/a", 1, 5.002), (3, "/b", 1, 5.0), (1, "/a", 2, 6.0)], "id long, path string, size long, mtime double")
    got = {(r.id, r.size): r.md5 for r in caches.cache_lookup(rows, cache).collect()}
    assert got == {(1, 1): "m", (2, 1): None, (3, 1): None, (1, 2): None}
    pairs = spark.createDataFrame([("/b", 2, 1.0, "/a", 1, 1.0, True, 1.0), ("/a", 1, 1.0, "/b", 2, 1.0, False, 2.0)], "a_path string, a_size long, a_mtime double, b_path string, b_size long, b_mtime double, same boolean, seen_at double")
    seen = caches.verify_upsert(pairs)
    assert [(r.a_path, r.same) for r in seen.collect()] == [("/a", False)]
    assert [r.same for r in caches.verify_lookup(pairs.drop("same", "seen_at"), seen).collect()] == [False, False]
    assert [r.same for r in caches.verify_lookup(pairs.limit(1).drop("same", "seen_at").withColumn("a_mtime", F.lit(1.5)), seen).collect()] == [None]
    assert caches.invalidate_verified(seen, spark.createDataFrame([("/b",)], "path string")).collect() == []


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, [(1, 2)] * 5) for i in range(50)], "id long, t string, p array<struct<a:long,b:long>>")
    assert row_bytes(df) == 50 * (32 + 8 + 108 + 5 * 32 + 24)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString()
    assert hinted(small(df)) and not hinted(small(df, 1000))
    assert row_bytes(df.filter("false")) == 0


def test_exif_and_empty_members(spark):
    f, g, m, s = scan_tables(spark)
    empty = m.filter("false")
    assert results.groups_page(g, empty, f, s).collect() == []
    assert folders.folder_pairs(empty, f).collect() == [] and folders.newest_kept(empty, f).collect() == []
    assert suggest.suggestions(g, empty, f, NOW).collect() == []
