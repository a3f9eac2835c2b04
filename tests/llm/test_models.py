"""Models on held-out rows, decoders against enumeration, dynamic programmes against all cuts."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorlake.llm import docstats, gam, packing, pii, rules, secret_scan, toxicity
from mirrorlake.llm import text as T
from tests.llm.fixtures import frame, prose, words


def made(seed, n=1200):
    """Rows whose label depends on one feature, and on two others together."""
    r = np.random.default_rng(seed)
    x = r.random((n, 5))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) & (x[:, 3] < 0.9)).astype(float)
    return x, y


def test_gam_holds_out():
    model = gam.fit(*made(1))
    x, y = made(2)
    p = model.probability(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.9
    assert (1, 2) in {(i, j) for i, j, *_ in model.pairs}
    slow = [model.bias + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, row, strict=True)) + sum(t[np.searchsorted(a, row[i], "right"), np.searchsorted(b, row[j], "right")] for i, j, a, b, t in model.pairs) for row in x[:50]]
    assert np.allclose(model.log_odds(x[:50]), slow)


def walk(f, row):
    total = f.bias
    for at in f.roots:
        while f.left[at] != at:
            at = f.left[at] if row[f.feature[at]] <= f.cut[at] else f.right[at]
        total += f.value[at]
    return total


def test_trees_hold_out_and_stay_monotone():
    names = tuple("abcde")
    o = rules.RuleOptions(directions=(("a", 1), ("d", -1)))
    f = rules.fit(*made(1), o, names)
    x, y = made(2)
    assert ((f.probability(x) >= 0.5) == (y == 1)).mean() > 0.9
    assert np.allclose(f.log_odds(x[:60]), [walk(f, row) for row in x[:60]])
    for j, sign in ((0, 1), (3, -1)):
        grid = np.repeat(x[:40], 41, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 41), 40)
        steps = np.diff(f.log_odds(grid).reshape(40, 41), axis=1) * sign
        assert steps.min() >= -1e-9


@pytest.mark.parametrize("fit", [gam.fit, rules.fit])
def test_no_rows_and_one_class(fit):
    m = len(docstats.FEATURES)
    assert fit(np.zeros((0, m)), np.zeros(0)).probability(np.zeros((2, m))).tolist() == [0.5, 0.5]
    assert fit(np.random.default_rng(1).random((30, m)), np.ones(30)).probability(np.zeros((1, m)))[0] > 0.9


def labelled(spark, seed, n=400):
    """Prose, of which some is junk and some has words that go with toxicity."""
    r = random.Random(seed)
    bad = ["zorb", "glim", "frak", "wex", "nutz"]
    docs, labels = [], []
    for i in range(n):
        w = prose(r, r.randint(30, 120), 800).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        if junk:
            w = [x + "###" for x in w[:20]] + [w[0]] * 60
            if toxic:
                w += bad[:3]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return frame(spark, docs), labels


def test_document_models_on_unlabelled_rows(spark):
    docs, labels = labelled(spark, 1)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    rest = {i: (q, t) for i, q, t in labels if i % 2 == 0}
    kept = {r.doc_id for r in gam.quality_keep(docs, known).collect()}
    assert np.mean([(i in kept) == q for i, (q, _) in rest.items()]) > 0.95
    kept = {r.doc_id for r in rules.rules_keep(docs, known).collect()}
    assert np.mean([(i in kept) == q for i, (q, _) in rest.items()]) > 0.95
    assert {r.doc_id for r in rules.drop_bad(docs, known).collect()} == kept
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known).collect()}
    assert np.mean([(got[i].toxic >= 0.5) == t for i, (_, t) in rest.items()]) > 0.95
    assert np.mean([(got[i].hostile_junk >= 0.5) == (t and not q) for i, (q, t) in rest.items()]) > 0.9
    part = known.withColumn("quality", __import__("pyspark.sql.functions").sql.functions.expr("if(doc_id % 4 = 1, null, quality)"))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, part).collect()}  # toxic labels count without a quality
    assert np.mean([(got[i].toxic >= 0.5) == t for i, (_, t) in rest.items()]) > 0.95
    flagged = {r.doc_id for r in toxicity.toxic_documents(docs, known).collect()}
    assert flagged == {i for i, r in got.items() if r.toxic >= 0.5}


def test_chain_feeds_probabilities_forward():
    r = np.random.default_rng(1)
    x = (r.random((300, 4)) < 0.5).astype(float)
    a = x[:, 0]
    y = np.column_stack([a, a * x[:, 1], a * x[:, 2]])
    chain = toxicity.fit(x, y, np.arange(4, dtype=np.uint64), toxicity.ToxicityOptions())
    assert [len(w) for w in chain.weights] == [5, 6, 7]
    p = chain.predict(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97
    first = toxicity._apply(x, chain.weights[0])
    assert np.allclose(p[:, 1], toxicity._apply(np.column_stack([x, first]), chain.weights[1]))


def test_chain_with_unknown_labels_and_folds_of_their_own():
    """Out-of-fold predictions use the columns of their fold; rows of unknown label train nothing."""
    r = np.random.default_rng(5)
    x = (r.random((400, 3)) < 0.5).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0] * x[:, 1]])
    fold = np.arange(400) % 5
    y[:100, 1] = np.nan
    every = np.arange(3)
    chain = toxicity.fit(x, y, np.arange(3, dtype=np.uint64), toxicity.ToxicityOptions(), fold, [every] * 6)
    assert ((chain.predict(x)[100:] >= 0.5) == (y[100:] == 1)).mean() > 0.97
    blind = toxicity.fit(x, y, np.arange(3, dtype=np.uint64), toxicity.ToxicityOptions(), fold, [every] + [np.array([2])] * 5)
    assert abs(blind.weights[1][3]) < abs(chain.weights[1][3])  # folds that don't see the word say nothing of use


def test_secrets_that_only_name_things():
    """UUIDs and hashes of commits can't be told from keys by their characters: most are taken for secrets."""
    o = secret_scan.SecretOptions()
    model = secret_scan.fit([], o)
    r = random.Random(3)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    share = {}
    for name, made in {"uuid": lambda: "-".join(map(hexes, (8, 4, 4, 4, 12))), "commit": lambda: hexes(40), "short commit": lambda: hexes(7), "date": lambda: f"20{r.randrange(10, 30)}-0{r.randrange(1, 9)}-1{r.randrange(9)}T10:00", "path": lambda: "/".join(r.choices(secret_scan._COMMON, k=4))}.items():
        raw, offs = T.buffers(__import__("pyarrow").array([f"see {made()} now" for _ in range(300)]))
        found = np.searchsorted(offs, model.hits(raw, offs, o)[0], "right")
        share[name] = len(set(found.tolist())) / 300
    assert share["uuid"] > 0.9 and share["commit"] > 0.95
    assert share["short commit"] < 0.05 and share["date"] < 0.02 and share["path"] < 0.02


def test_secrets_hold_out():
    o = secret_scan.SecretOptions()
    model = secret_scan.fit(["wordy", "passage", "straße", "élan", "window"], o)
    keys = secret_scan.random_strings(500, 99)
    plain = [s for s in secret_scan.identifiers(secret_scan._COMMON, 900, 98) if len(s) >= o.least_length]
    assert np.mean([model.of(s) >= o.threshold for s in keys]) > 0.98
    assert np.mean([model.of(s) >= o.threshold for s in plain]) < 0.02
    raw, offs = T.buffers(__import__("pyarrow").array([f"a {keys[0]} b", "", f"{keys[1]}", "short"]))
    start, end, score = model.tokens(raw, offs, o.least_length)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == keys[:2]
    assert np.allclose(score, [model.of(k) for k in keys[:2]])


def test_secrets_inside_longer_tokens():
    o = secret_scan.SecretOptions()
    model = secret_scan.fit(["wordy", "passage", "straße", "élan", "window"], o)
    r = __import__("random").Random(4)
    b62 = secret_scan.string.ascii_letters + secret_scan.string.digits
    path = "home/user/server/config/session/data/"

    def left(texts):
        """What stays of each text without its secrets."""
        raw, offs = T.buffers(__import__("pyarrow").array(texts))
        start, end, _ = model.hits(raw, offs, o)
        assert (start[1:] >= end[:-1]).all()
        kept = np.ones(len(raw), bool)
        for a, b in zip(start, end, strict=True):
            kept[a:b] = False
        return [raw[a:b][kept[a:b]].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]

    for letters, n, head, tail in [(b62, 20, path, ""), ("0123456789abcdef", 32, path, ""), (b62, 20, "größe漢字", ""), (b62, 15, "", ""), (b62, 12, "", ""), (b62, 24, path, "/" + path)]:
        keys = ["".join(r.choices(letters, k=n)) for _ in range(300)]
        rest = left([f"see {head}{k}{tail} now" for k in keys])
        clean = {f"see {head[:i]}{tail[j:]} now" for i in range(len(head) + 1) for j in range(len(tail) + 1)}  # the key is gone whole
        assert np.mean([x in clean for x in rest]) > 0.95
    two = [["".join(r.choices(b62, k=20)) for _ in range(2)] for _ in range(300)]
    clean = {path + f"/{path}"[j:] for j in range(6)}  # at most one part of the path between goes with them
    assert np.mean([x in clean for x in left([f"{path}{a}/{path}{b}" for a, b in two])]) > 0.95
    plain = secret_scan.identifiers(secret_scan._COMMON, 900, 98)
    assert np.mean([x != y for x, y in zip(left(plain), plain, strict=True)]) < 0.02
    v = [r.gauss(0, 3) for _ in range(200)]
    place = np.array([0, 1, 60, 61, 150, 200])
    want = [max(sum(v[i:j]) for i in range(a, b) for j in range(i, b + 1)) for a, b in zip(place, place[1:])]
    assert np.allclose(secret_scan._best(np.array(v), place), want)


def segmentations(n, found):
    """All ways to part n tokens into plain ones and labelled spans."""
    if n == 0:
        yield ()
        return
    for rest in segmentations(n - 1, found):
        yield (*rest, (n - 1, n, len(pii.KINDS)))
    for i, j, _ in found:
        if j == n:
            for rest in segmentations(i, found):
                for k in range(len(pii.KINDS)):
                    yield (*rest, (i, j, k))


def test_pii_decoding_equals_enumeration():
    r = np.random.default_rng(2)
    for text in ("call 555-123-4567 now", "a@b.com or", "10.0.0.1 x 12345678", "+1 (555) 123-4567"):
        for _ in range(3):
            model = pii.SemiCrf(r.normal(size=(4, len(pii.FEATURES))), r.normal(size=(5, 5)), 24)
            spans, found = model.lattice(text)
            feats = {(i, j): f for i, j, f in found}

            def value(seg, model=model, feats=feats):
                y, total = 4, 0.0
                for i, j, k in seg:
                    total += model.steps[y, k] + (model.scores(feats[i, j])[k] if k < 4 else 0.0)
                    y = k
                return total + model.steps[y, 4]

            best = max(segmentations(len(spans), found), key=value)
            want = [(spans[i][0], spans[j - 1][1], pii.KINDS[k]) for i, j, k in best if k < 4]
            assert [e[:3] for e in model.entities(text)] == want


def test_pii_gradient_equals_differences():
    text = "x 555-123-4567 y"
    r = np.random.default_rng(3)
    w, t = r.normal(size=(4, len(pii.FEATURES))) * 0.3, r.normal(size=(5, 5)) * 0.3
    model = pii.SemiCrf(w, t, 24)
    spans, found = model.lattice(text)
    truth = {(1, 6): 1}
    assert (1, 6) in {(i, j) for i, j, _ in found}
    gw, gt = np.zeros_like(w), np.zeros_like(t)
    base = pii._gradient(model, len(spans), found, truth, gw, gt)
    assert base < 0
    for a, g in ((w, gw), (t, gt)):
        for at in list(zip(*np.nonzero(np.abs(g) > 1e-3), strict=True))[:6]:
            a[at] += 1e-5
            up = pii._gradient(pii.SemiCrf(w, t, 24), len(spans), found, truth, np.zeros_like(w), np.zeros_like(t))
            a[at] -= 1e-5
            assert abs((up - base) / 1e-5 - g[at]) < 1e-2


def test_pii_holds_out():
    model = pii.fit(pii.PiiOptions())
    right = total = said = 0
    for text, truth in pii.sentences(300, 77):
        got = {e[:3] for e in model.entities(text)}
        right, total, said = right + len(got & set(truth)), total + len(truth), said + len(got)
    assert right / total > 0.9 and right / said > 0.9


def test_pii_whole_spans_and_scores(spark):
    """Addresses of any length come back whole; each score is what plain text in its place would lose."""
    long = "a" * 300 + "@mail.example.com"
    texts = {1: f"x {long} y", 2: f"{'b' * 5000}.c@{'d' * 400}.org", 3: "call 555-1234 or 10.0.0.1, 555-123-4567", 4: "漢字" * 200 + " 555-123-4567"}
    rows = pii.pii(frame(spark, texts.items())).collect()
    assert {(x.doc_id, x.span) for x in rows if x.kind == "email"} == {(1, long), (2, texts[2])}
    assert all(texts[x.doc_id][x.start : x.end] == x.span and x.score >= -1e-9 for x in rows)
    assert {x.span for x in rows if x.doc_id == 4} == {"555-123-4567"}


def test_pii_regions_give_what_whole_texts_give(spark):
    r = random.Random(8)
    texts = {}
    for i in range(40):
        parts = []
        for text, _ in pii.sentences(3, 1000 + i):
            parts += [prose(r, r.randint(0, 60)), text]
        texts[i] = " ".join(parts)
    model = pii.fit(pii.PiiOptions())
    want = sorted((i, k, a, b, t[a:b]) for i, t in texts.items() for a, b, k, _ in model.entities(t))
    got = sorted((x.doc_id, x.kind, x.start, x.end, x.span) for x in pii.pii(frame(spark, texts.items())).collect())
    assert len(want) > 100 and got == want


def cost(tokens, ends_doc, ends, o):
    total, i = 0.0, 0
    for j in ends:
        n = int(sum(tokens[i:j]))
        total += o.pad * max(0, o.window - n) + o.truncate * max(0, n - o.window) + (0 if ends_doc[j - 1] else o.split)
        i = j
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 14), st.booleans()), min_size=1, max_size=11), st.sampled_from([0.5, 2.0, 9.0]), st.sampled_from([0.0, 3.0]))
def test_packing_equals_all_cuts(units, truncate, split):
    o = packing.PackOptions(window=10, truncate=truncate, split=split)
    tokens = np.array([n for n, _ in units])
    ends_doc = np.array([e for _, e in units[:-1]] + [True])
    ends, value = packing.cuts(tokens, ends_doc, o)
    assert ends[-1] == len(units) and abs(cost(tokens, ends_doc, ends, o) - value) < 1e-9
    every = (cost(tokens, ends_doc, [*c, len(units)], o) for k in range(len(units)) for c in itertools.combinations(range(1, len(units)), k))
    assert abs(value - min(every)) < 1e-9


def test_packing_rows(spark):
    r = random.Random(9)
    texts = {i: prose(r, r.choice([5, 300, 2500])) for i in range(30)} | {5000: prose(r, 50)}
    o = packing.PackOptions(window=512, shard_sentences=400)
    counts = {i: packing.sentence_tokens(*T.buffers(__import__("pyarrow").array([t])), o)[0] for i, t in texts.items()}
    want, before = {}, 0
    for i in sorted(texts):
        want.setdefault(before // o.shard_sentences, []).append(i)
        before += len(counts[i])
    rows = sorted(packing.pack_documents(frame(spark, texts.items()), o).collect())
    assert {x.shard for x in rows} == set(want) and len(want) > 3
    for shard, ids in want.items():
        own = [x for x in rows if x.shard == shard]
        assert list(dict.fromkeys(i for x in own for i in x.doc_ids)) == ids
        assert sum(x.n_tokens for x in own) == sum(counts[i].sum() for i in ids)
        tokens = np.concatenate([counts[i] for i in ids])
        ends_doc = np.concatenate([np.arange(1, len(counts[i]) + 1) == len(counts[i]) for i in ids])
        paid = sum(o.pad * x.padding + o.truncate * x.truncated + o.split * x.ends_inside for x in own)
        assert abs(paid - packing.cuts(tokens, ends_doc, o)[1]) < 1e-6


def test_packing_does_not_depend_on_how_dense_ids_are(spark):
    """Hashed ids, and one id that a third of all rows have, are packed as full as ids in a row."""
    r = random.Random(10)
    texts = [prose(r, 20) for _ in range(900)]
    o = packing.PackOptions(window=512, shard_sentences=600)
    padding = []
    for name in (lambda i: i, lambda i: (i * 0x9E3779B97F4A7C15) % 2**64 - 2**63, lambda i: 7 if i % 3 else i):
        rows = packing.pack_documents(frame(spark, [(name(i), t) for i, t in enumerate(texts)]).repartition(4), o).collect()
        assert len({x.shard for x in rows}) == 3
        assert sum(len(x.doc_ids) for x in rows) >= len(texts)
        padding.append(sum(x.padding for x in rows))
    assert max(padding) <= 2 * min(padding) and max(padding) < 4 * o.window


def test_packing_with_a_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    text = "One sentence here. Another one!\nAnd a third <|endoftext|> line"
    rows = packing.pack_documents(frame(spark, [(1, text)]), packing.PackOptions(tokenizer=path)).collect()
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert rows[0].n_tokens == sum(len(t.encode(s, add_special_tokens=False).ids) for s in packing.sentence_spans(text))


def test_words_and_hashes_of_batches():
    import pyarrow as pa

    texts = ["one two two", "", None, "two_3 é-x", "a" * 2_000_000 + " end", "one two two", "“one”\u00a0two—two…", "漢字ひらx カナไทย한국 𠀀٣ 🙂", "x漢"]
    raw, offs = T.buffers(pa.array(texts))
    word, first = T.words(raw, offs)
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    by = {}
    for w, h in zip(flat, word.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    sh, place = T.sets(word, first, 3)
    assert np.diff(place).tolist()[:7] == [1, 0, 0, 1, 1, 1, 1] and sh[place[0]] == sh[place[5]] == sh[place[6]]


def test_words_of_all_scripts():
    """Against another library's idea of scripts and categories."""
    import pyarrow as pa

    r = random.Random(1)
    letters = "ab_9 .,’“—\u00a0é漢字ひらカナไทยम한국🙂𠀀٣\n"
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(2000)]
    raw, offs = T.buffers(pa.array(texts))
    got = [[] for _ in texts]
    for pos, _, start, end in T.runs(raw, offs):
        for a, b in zip(start + pos, end + pos, strict=True):
            got[np.searchsorted(offs, a, "right") - 1].append(raw[a:b].tobytes().decode())
    assert got == [words(t) for t in texts]
