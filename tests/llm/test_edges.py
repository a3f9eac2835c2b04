"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mirrorlake.llm import chat, gam, leaks, near, packing, pii, repeats, rules, secret_scan, toxicity
from tests.llm.fixtures import CLASH, DOCS, frame, prose

R = random.Random(2)
BASE = prose(R, 120)
LONG = prose(R, 150_000)
JUNK = "### $$$ " * 40
SECRET = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " " + prose(R, 60)), (4, None), (5, ""), (6, "   \n\t "), (7, "!!! ... ###"), (8, "word"), (9, LONG), (10, "x" * 200_000), (11, "same " * 30_000),
    (None, BASE), (None, None), (12, JUNK), (13, f'a token = "{SECRET}" and mail a.b@mail1.example.com'), (14, "ünï çödé 漢字 " * 30), (15, "nul \x00 inside " * 5), (16, BASE, None, None, None),
]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 1, None), (8, None, None), (12, 0, 1), (12, 0, 1), (None, 1, 1), (99, 1, 0)]
ITEMS = [(1, BASE[:300]), (2, ""), (3, None), (None, BASE[:200]), (4, "two words"), (5, LONG[40_000:42_000]), (5, LONG[40_000:42_000])]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit(f"-{c}") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(7)).cache()


def nothing(df):
    return df.filter("false")


OPERATORS = {
    "pii": lambda d, l, i: pii.pii(d),
    "gam": lambda d, l, i: gam.quality_scores(d, l),
    "toxicity": lambda d, l, i: toxicity.toxicity_scores(d, l),
    "secrets": lambda d, l, i: secret_scan.secrets(d, l),
    "packing": lambda d, l, i: packing.pack_documents(d),
    "repeats": lambda d, l, i: repeats.repeated_passages(d),
    "rules": lambda d, l, i: rules.rule_scores(d, l),
    "near": lambda d, l, i: near.near_groups(d),
    "leaks": lambda d, l, i: leaks.leaks(d, i),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(name, docs, wide, labels, items):
    plain = OPERATORS[name](docs, labels, items)
    got = OPERATORS[name](wide, labels, items)
    assert got.columns == plain.columns
    key = lambda rows: sorted(map(str, rows))
    assert key(got.collect()) == key(plain.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels, items):
    assert OPERATORS[name](nothing(docs), labels, items).collect() == []
    assert OPERATORS[name](nothing(docs), nothing(labels), nothing(items)).collect() == []
    OPERATORS[name](docs, nothing(labels), nothing(items)).collect()


def test_models_score_every_row(docs, labels):
    for df, score in ((gam.quality_scores(docs, labels), "quality"), (rules.rule_scores(docs, labels), "score"), (toxicity.toxicity_scores(docs, labels), "toxic")):
        got = df.collect()
        assert len(got) == len(ROWS)
        assert all(0 <= r[score] <= 1 for r in got)
        assert len({r[score] for r in got if r.doc_id == 2}) == 1
    got = gam.quality_scores(docs, nothing(labels)).collect()
    assert {(r.quality, r.keep) for r in got} == {(0.5, True)}
    assert {r.keep for r in rules.rule_scores(docs, nothing(labels)).collect()} == {True}
    assert max(r.toxic for r in toxicity.toxicity_scores(docs, nothing(labels)).collect()) < 1e-6


def test_near_groups(docs):
    got = {r.doc_id: r.duplicate_of for r in near.near_groups(docs).collect()}
    assert got == {2: 1, 3: 1, 16: 1}
    assert near.near_groups(docs.filter("doc_id in (4, 5, 6, 7)")).collect() == []


def test_drop_near_keeps_one_of_each_and_rows_without_id(docs, wide):
    for d in (docs, wide):
        kept = near.drop_near(d)
        assert kept.columns == d.columns
        ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
        assert ids == [1, *range(4, 16), None, None]


def test_repeats(docs):
    got = {(r.doc_id, r.first_word, r.n_words, r.first_doc) for r in repeats.repeated_passages(docs).collect()}
    assert got == {(1, 0, 120, 1), (2, 0, 120, 1), (3, 0, 120, 1), (16, 0, 120, 1)}


def test_leaks(docs, items):
    got = {(r.doc_id, r.item_id): r.containment for r in leaks.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (16, 1), (9, 5)}
    assert got[1, 1] > 0.95 and got[9, 5] > 0.95
    kept = leaks.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15]


def test_secrets(docs, labels, wide):
    found = secret_scan.secrets(docs, None).collect()
    assert [(r.doc_id, r.start, r.end) for r in found if r.doc_id != 10] == [(13, 11, 51)]
    for d in (docs, wide):
        clean = secret_scan.redact(d, labels)
        assert clean.columns == d.columns
        rows = clean.collect()
        assert len(rows) == len(ROWS)
        hit = next(r for r in rows if r.doc_id == 13)
        assert SECRET not in hit.text and "[SECRET]" in hit.text and hit.n_chars == len(hit.text)
        assert [r.text for r in rows if r.doc_id == 4] == [None]


def test_pii(docs):
    assert [(r.doc_id, r.kind, r.span) for r in pii.pii(docs).collect() if r.doc_id == 13 and r.kind == "email"] == [(13, "email", "a.b@mail1.example.com")]


def test_packing_leaves_out_what_has_no_tokens(docs):
    rows = packing.pack_documents(docs).collect()
    seen = {i for r in rows for i in r.doc_ids}
    assert seen == {1, 2, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16}
    assert all(r.n_tokens + r.padding - r.truncated == packing.PackOptions().window for r in rows)


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 2, "user", "b"), (1, 1, None, None), (1, 2, "user", "b"), (1, None, "user", ""), (None, 1, "user", "x"), (2, 1, "user", '[{"type":"image","url":"u","width":56,"height":29},null]'), (3, 1, "user", "[1, 2"), (4, 1, "user", "y" * 300_000)],
        "conv_id long, turn long, role string, text string",
    ).withColumns({c: F.lit(1) for c in ("parts", "place", "own", "before", "m", "n")})
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].n_messages == 4 and got[1].formatted.startswith("<|user|>\n<|end|>\n<|unknown|>\n<|end|>\n<|user|>\nb")
    assert got[2].n_attachments == 0 and "[{" in got[2].formatted  # a list with a null entry is text
    assert got[4].n_tokens == 75_000
    assert chat.format_chats(nothing(turns)).collect() == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory, labels, items):
    at = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{at}/labels.parquet")
    items.write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def bare_folder(tmp_path_factory, labels, items):
    at = str(tmp_path_factory.mktemp("empty"))
    nothing(labels).write.parquet(f"{at}/labels.parquet")
    nothing(items).write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage, docs, wide, folder, bare_folder):
    last = name == corpus_pipeline.STAGES[-1][0]
    for d in (docs, wide):
        for at in (folder, bare_folder):
            out = stage(spark, d, at)
            assert last or out.schema == d.schema or out.columns == d.columns
            out.collect()
    for at in (folder, bare_folder):
        assert stage(spark, nothing(docs), at).collect() == []


def test_long_ids_and_schema(spark):
    d = spark.createDataFrame([(2**62, BASE), (-5, BASE)], "doc_id long, text string")
    assert [(r.doc_id, r.duplicate_of) for r in near.near_groups(d).collect()] == [(2**62, -5)]
    assert {i for r in packing.pack_documents(d).collect() for i in r.doc_ids} == {2**62, -5}
    small = d.filter("doc_id < 0").withColumn("doc_id", F.col("doc_id").cast("int"))
    assert near.drop_near(small).schema == small.schema
    assert DOCS
