"""Searches against brute force: near copies, benchmark items, repeated passages, suffix order."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorlake.llm import leaks, near, repeats
from mirrorlake.llm.suffixes import Scratch, SortOptions, suffix_order
from mirrorlake.operators import lineage
from tests.llm.fixtures import corpus, frame, prose, shingles, words


def pairs_at_least(texts, k, threshold):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    out = {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                out[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    return out


def groups_of(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(spark, seed):
    o = near.NearOptions()
    texts = corpus(seed, 150)
    found = {r.doc_id: r.duplicate_of for r in near.near_groups(frame(spark, texts.items())).collect()}
    same = groups_of([(a, b) for a, b in found.items()])
    lowest = pairs_at_least(texts, o.shingle, o.threshold - 2 * o.error / 3)
    pairs = pairs_at_least(texts, o.shingle, o.threshold)
    hit = [p for p in pairs if same.get(p[0], p[0]) == same.get(p[1], p[1])]
    assert len(pairs) > 50 and len(hit) >= 0.95 * len(pairs)
    loose = groups_of(lowest)
    assert all(loose.get(a) == loose.get(b) for a, b in found.items())  # nothing unlike is joined


def test_near_recall_with_branching_nodes(spark):
    """Nodes are made to branch in Spark and in the task; a shared passage makes them large."""
    r = random.Random(5)
    shared = prose(r, 30)
    texts = {}
    for i in range(400):
        own = prose(r, 40) if i % 2 == 0 else texts[i - 1][len(shared) + 1 :].replace("w1", "z", 2)
        texts[i] = shared + " " + own
    o = near.NearOptions(node_limit=20, split_rows=60)
    found = {x.doc_id: x.duplicate_of for x in near.near_groups(frame(spark, texts.items()), o).collect()}
    same = groups_of(found.items())
    pairs = pairs_at_least(texts, o.shingle, o.threshold)
    hit = sum(same.get(a, a) == same.get(b, b) for a, b in pairs)
    assert len(pairs) >= 190 and hit >= 0.9 * len(pairs)


IDS = {"negative": lambda i: -(i + 2) * 1_000_003, "minus one": lambda i: i - 20, "hashed": lambda i: (i * 0x9E3779B97F4A7C15 + 12345) % 2**64 - 2**63, "mixed": lambda i: (-1) ** i * i * 977}


@pytest.mark.parametrize("kind, options", [("negative", {}), ("minus one", {}), ("hashed", {}), ("mixed", {"node_limit": 10, "split_rows": 25, "split_rounds": 1})])
def test_any_ids_give_the_same_groups(spark, kind, options):
    """60 near-equal texts in one node, others around; branching in the task, in Spark and in blocks."""
    r = random.Random(8)
    base = prose(r, 80).split()
    texts = {i: " ".join([*base[: 70 + i % 7], f"end{i}"]) for i in range(60)} | {100 + i: t for i, t in corpus(4, 60).items()}

    def parted(name):
        rows = [(name(i), t) for i, t in texts.items()]
        back = {name(i): i for i in texts}
        found = near.near_groups(frame(spark, rows), near.NearOptions(**options)).collect()
        same = groups_of([(x.doc_id, x.duplicate_of) for x in found])
        out = defaultdict(set)
        for i, g in same.items():
            out[g].add(back[i])
        assert all(min(name(i) for i in m) == g for g, m in out.items())
        return sorted(map(sorted, out.values()))

    want = parted(lambda i: i)
    assert want[0] == list(range(60)) and len(want) > 10
    got = parted(IDS[kind])
    if not options:
        assert got == want
    else:  # which documents lead depends on the ids, and so do a few of the weakest links
        assert got[0] == want[0] and sum(g in want for g in got) >= 0.9 * len(want)


def test_one_hot_cluster_ends_early(spark):
    """Copies that no token parts are linked to leaders and leave the search; outsiders are still compared with them."""
    r = random.Random(9)
    base = prose(r, 100).split()
    texts = {i: " ".join([*base, f"end{i}"]) for i in range(300)}
    texts |= {1000: " ".join(base[:72] + prose(r, 12).split()), 1001: prose(r, 90)}
    o = near.NearOptions(split_rows=40, node_limit=20, trees=3)
    docs = frame(spark, texts.items())
    found = {x.doc_id: x.duplicate_of for x in near.near_groups(docs, o).collect()}
    assert found == dict.fromkeys([*range(1, 300), 1000], 0)
    links = near.candidate_links(near.signatures(docs, o), o).count()
    assert links < 20 * len(texts)  # a few for each document, not all pairs


def test_one_id_with_two_texts(spark):
    r = random.Random(10)
    a, b = prose(r, 90), prose(r, 90)
    rows = [(1, a), (2, b), (3, a + " more"), (4, b + " more"), (2, a + " other")]
    found = {x.doc_id: x.duplicate_of for x in near.near_groups(frame(spark, rows)).collect()}
    assert found == {2: 1, 3: 1, 4: 1}
    for order in (rows, rows[::-1]):
        kept = near.drop_near(frame(spark, [(i, t) for i, t in order if i == 2])).collect()
        assert [x.text for x in kept] == [min(t for i, t in rows if i == 2)]


def test_quotes_dashes_and_spaces_do_not_count(spark):
    r = random.Random(11)
    w = prose(r, 100).replace(".", "").split()
    plain, fancy = " ".join(w), "“" + "”\u00a0‘".join(" — ".join(w[i : i + 5]) for i in range(0, 100, 5)) + "…"
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(120))
    rows = [(1, plain), (2, fancy), (3, han), (4, han[:110] + "。" + han[110:])]
    assert {x.doc_id: x.duplicate_of for x in near.near_groups(frame(spark, rows)).collect()} == {2: 1, 4: 3}
    got = {(x.doc_id, x.first_word, x.n_words) for x in repeats.repeated_passages(frame(spark, rows)).collect()}
    assert got == {(1, 0, 100), (2, 0, 100), (3, 0, 120), (4, 0, 120)}
    items = spark.createDataFrame([(1, " ".join(w[20:50])), (2, han[30:60])], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaks(frame(spark, rows), items).collect()} == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_clusters_linked_by_their_copies_only():
    """0 and 2 are too unlike, and only their copies 1 and 3 are alike enough."""
    compare = near._Compare(near.NearOptions())
    compare.maybe = compare.sure = 4.5
    sig = np.zeros((4, near.TOKENS), np.uint8) + np.arange(4, dtype=np.uint8)[:, None]
    sig[1, :5] = sig[0, :5]  # 0 and 1, 2 and 3, 1 and 3 have five tokens in common, others none
    sig[3, 10:15] = sig[2, 10:15]
    sig[3, 20:25] = sig[1, 20:25]
    assert compare.node(np.arange(4), sig, 1) == [(0, 1, True), (1, 3, True), (2, 3, True)]
    compare.sure = 6
    assert compare.node(np.arange(4), sig, 1) == [(0, 1, False), (1, 3, False), (2, 3, False)]


def test_many_copies_of_one_text(spark):
    r = random.Random(3)
    base = prose(r, 100).split()
    texts = {i: " ".join([*base[:-1], f"end{i}"]) for i in range(700)}
    found = {x.doc_id: x.duplicate_of for x in near.near_groups(frame(spark, texts.items())).collect()}
    assert found == dict.fromkeys(range(1, 700), 0)


def brute_leaks(texts, items, k, threshold):
    """Best containment within any stretch of twice an item's size."""
    out = {}
    for d, t in texts.items():
        w = words(t)
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for i, item in items.items():
            want = words(item)
            if len(want) < k:
                continue
            own = {tuple(want[j : j + k]) for j in range(len(want) - k + 1)}
            span = len(want) - k + 1
            best = max((len(own & set(grams[j : j + span])) for j in range(max(1, len(grams) - span + 1))), default=0) / len(own)
            if best >= threshold:
                out[d, i] = best
    return out


@pytest.mark.parametrize("filter_bytes", [32 << 20, 512])
def test_leaks_equal_brute_force(spark, filter_bytes):
    """In one pass over the documents, and in four with parts of the filter."""
    r = random.Random(4)
    items = {i: prose(r, r.choice([3, 8, 20, 33, 64, 90])) for i in range(25)}
    texts = {}
    for d in range(60):
        w = prose(r, r.choice([10, 200, 900])).split()
        if d % 2:
            own = items[r.randrange(25)].split()
            for j in range(len(own)):
                if len(own) > 15 and r.random() < 0.02:
                    own[j] = "changed"
            at = r.randrange(len(w))
            w[at:at] = [x.upper() for x in own]
        texts[d] = " ".join(w)
    o = leaks.LeakOptions(filter_bytes=filter_bytes)
    got = {(x.doc_id, x.item_id): x for x in leaks.leaks(frame(spark, texts.items()), spark.createDataFrame(list(items.items()), "item_id long, text string"), o).collect()}
    want = brute_leaks(texts, items, o.shingle, o.threshold)
    assert len(want) >= 20
    assert len(set(want) & set(got)) >= 0.95 * len(want)
    for (d, i), x in got.items():  # exact shares in a window, which is wider than the item
        own = shingles(items[i], o.shingle)
        assert x.containment <= len(own & shingles(texts[d], o.shingle)) / len(own) + 1e-9
        if (d, i) in want:
            assert x.containment >= want[d, i] - 1e-9 or x.containment >= o.threshold


def test_leak_filter_lets_little_through(spark):
    """However large the benchmark, what goes on to the join is a small part of the text."""
    r = random.Random(12)
    items = spark.createDataFrame([(i, prose(r, 30, 10**6)) for i in range(3000)], "item_id long, text string")
    texts = [(i, prose(r, 400, 10**6)) for i in range(300)]
    o = leaks.LeakOptions(filter_bytes=1 << 16)
    keys = leaks.item_index(items, o).selectExpr("explode(keys) as key", "size").selectExpr("key ^ size as key")
    assert keys.count() * leaks._BITS > 8 * o.filter_bytes
    some = keys.filter("pmod(xxhash64(key), 4) = 0")
    known = leaks._filter(some, 1 << 13)
    went = leaks._hits(frame(spark, texts), [32], known, o).count()
    windows = sum(-(-398 // 32) for _ in texts)
    assert went < 0.01 * windows * leaks.HASHES
    own = np.array([x.key for x in some.collect()])
    block, bits = leaks._places(own, 1 << 13)
    assert (known[block] & bits == bits).all()


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 160), st.sampled_from([1, 2, 3, 30]), st.sampled_from([3, 7, 10**6]), st.sampled_from([2, 10**6]))
def test_suffix_order_equals_sorting(seed, n, letters, range_size, buffer):
    r = np.random.default_rng(seed)
    text = np.append(r.integers(1, letters + 1, n) * 10**15, 0)
    if seed % 3 == 0:
        text[: n // 2] = text[n // 2 : n // 2 * 2]
    import tempfile

    with tempfile.TemporaryDirectory() as root, Scratch(root) as scratch:
        pos, lcp = suffix_order(scratch.keep(text), scratch, SortOptions(9, range_size, buffer))
        pos, lcp = np.array(pos), np.array(lcp)
    t = text.tolist()
    want = sorted(range(n), key=lambda i: t[i:], reverse=True)
    assert pos.tolist() == want

    def common(a, b):
        k = 0
        while k < 9 and t[a + k] == t[b + k]:
            k += 1
        return k

    assert lcp[1:].tolist() == [common(a, b) for a, b in zip(want, want[1:], strict=False)]


MEMORY = """
import re, sys, tempfile, threading, time
import numpy as np
from mirrorlake.llm import repeats
from mirrorlake.llm.suffixes import Scratch, SortOptions
def anonymous():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1))
pieces, r, seen, done = int(sys.argv[1]), np.random.default_rng(1), [], []
def watch():
    while not done:
        seen.append(anonymous())
        time.sleep(0.02)
with tempfile.TemporaryDirectory() as root, Scratch(root) as scratch:
    shard = repeats._Shard(scratch, repeats.RepeatOptions(sort=SortOptions(50, 40_000, 40_000)))
    threading.Thread(target=watch).start()
    passage = r.integers(1, 2**62, 60)
    for i in range(pieces):
        shard.add(i, i, 0, np.concatenate([r.integers(1, 2**62, 100), passage, r.integers(1, 50, 40)]).tobytes())
    n = sum(len(x[0]) for x in shard.repeats())
    done.append(1)
    print(n, max(seen))
"""


def test_memory_does_not_grow_with_the_shard():
    """The same passage in 1,000 and in 4,000 pieces of 200 words, at the same options."""
    import subprocess
    import sys

    took = {}
    for pieces in (1000, 4000):
        out = subprocess.run([sys.executable, "-c", MEMORY, str(pieces)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout.split()
        assert int(out[0]) == pieces
        took[pieces] = int(out[1])
    assert took[4000] < 1.2 * took[1000]


def brute_repeats(texts, size):
    seen = defaultdict(set)
    w = {d: words(t) for d, t in texts.items()}
    for d, own in w.items():
        for i in range(len(own) - size + 1):
            seen[tuple(own[i : i + size])].add(d)
    return {(d, j) for d, own in w.items() for i in range(len(own) - size + 1) if len(seen[tuple(own[i : i + size])]) > 1 for j in range(i, i + size)}


@pytest.mark.parametrize("shard_words, range_size, label_words", [(400_000, 1_000_000, 4_000_000), (2_000, 300, 4_000_000), (2_000, 300, 1_500)])
def test_repeats_equal_brute_force(spark, shard_words, range_size, label_words, tmp_path):
    r = random.Random(6)
    passages = [prose(r, n) for n in (49, 50, 51, 80, 300)]
    texts = {}
    for d in range(60):
        parts = [prose(r, r.randint(0, 150))]
        for _ in range(r.randint(0, 2)):
            parts += [r.choice(passages), prose(r, r.randint(0, 30))]
        texts[d] = " ".join(parts)
    texts[60] = "same " * 500  # repeats within one document only
    texts[61] = texts[0]
    texts[62] = " ".join(["again"] * 120)
    texts[63] = " ".join(["again"] * 75)
    texts |= {100 + i: texts[0] for i in range(20)}
    o = repeats.RepeatOptions(shard_words=shard_words, label_words=label_words, scratch=str(tmp_path), sort=SortOptions(50, range_size, 100))
    got = repeats.repeated_passages(frame(spark, texts.items()), o).collect()
    covered = {(x.doc_id, j) for x in got for j in range(x.first_word, x.first_word + x.n_words)}
    assert covered == brute_repeats(texts, 50)
    assert not list(tmp_path.iterdir())  # scratch files are gone
    assert all(x.first_doc <= x.doc_id and x.copies > 1 for x in got)


def test_joins_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    """The same results where every list is too large to be broadcast and all joins shuffle."""
    r = random.Random(14)
    passage, item = prose(r, 70), prose(r, 30)
    texts = corpus(5, 24) | {100 + i: prose(r, 20 + i) + " " + passage + " " + prose(r, 30) for i in range(4)} | {200: prose(r, 80) + " " + item + " " + prose(r, 9)}
    docs, items = frame(spark, texts.items()).cache(), spark.createDataFrame([(1, item), (2, prose(r, 20))], "item_id long, text string")
    o = repeats.RepeatOptions(scratch=str(tmp_path))
    ways = [lambda: near.near_groups(docs), lambda: leaks.leaks(docs, items), lambda: repeats.repeated_passages(docs, o)]
    want = [sorted(map(tuple, f().collect())) for f in ways]
    monkeypatch.setattr(lineage.small, "__defaults__", (-1,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(map(tuple, f().collect())) for f in ways] == want and all(want)
        assert "BroadcastHashJoin" not in leaks.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
