"""Document statistics for the quality models, and labelled samples of them.

All are computed from whole texts, a batch of documents at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mirrorlake.llm import text as T
from mirrorlake.operators.lineage import cut, small

FEATURES = ("log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "space_share", "high_share", "line_repeats", "gram_repeats", "log_line_words", "mark_words", "bare_words")

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|!~^<>{}[]\\=+_@/", np.uint8))
_LINE = np.arange(256) != 10
_TOKEN = ~T.IS_SPACE


def _repeats(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Share of each document's values that repeat an earlier one of it."""
    count = np.diff(place)
    doc = np.repeat(np.arange(len(count)), count)
    key = T.mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="quicksort")
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    extra = np.bincount(doc[order[again + 1]], minlength=len(count)) if len(again) else np.zeros(len(count))
    return extra / np.maximum(count, 1)


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[document, feature] of the documents between the offsets, finite for any text."""
    n = len(offs) - 1
    data, place = raw[offs[0] : offs[-1]], offs - offs[0]

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        some = np.diff(place) > 0
        out = np.zeros(n)
        if some.any():
            out[some] = np.add.reduceat(table[data], place[:-1][some], dtype=np.int64)
        return out / np.maximum(of, 1)

    size = np.diff(place).astype(float)
    ascii_letters = share(T.IS_UPPER, np.ones(n)) + share(T.IS_LOWER, np.ones(n))
    word, first = T.words(raw, offs)
    n_words = np.diff(first)
    grams, gplace = T.shingles(word, first, 5)
    lines, at, tokens, marked, bare = [], [], np.zeros(n), np.zeros(n), np.zeros(n)
    for pos, piece, start, end in T.runs(raw, offs, _LINE):
        lines.append(T.hashes(piece, start, end))
        at.append(start + pos)
    for pos, piece, start, end in T.runs(raw, offs, _TOKEN):
        doc = np.searchsorted(offs, start + pos, "right") - 1
        ends, heads = _SYMBOL[piece[end - 1]], T.IS_WORD[piece[start]]
        tokens += np.bincount(doc, minlength=n)
        marked += np.bincount(doc, ends, minlength=n)
        bare += np.bincount(doc, ~heads, minlength=n)
    lplace = np.searchsorted(np.concatenate(at), offs) if at else np.zeros(n + 1, np.int64)
    lines = np.concatenate(lines) if lines else np.zeros(0, np.uint64)
    n_lines = np.diff(lplace)
    return np.column_stack([
        np.log1p(n_words), np.minimum(size / np.maximum(n_words, 1), 200), share(T.IS_UPPER, ascii_letters), share(T.IS_DIGIT, size), share(_SYMBOL, size),
        share(T.IS_SPACE, size), share(np.arange(256) >= 128, size), _repeats(lines, lplace), _repeats(grams, gplace),
        np.log1p(n_words / np.maximum(n_lines, 1)), marked / np.maximum(tokens, 1), bare / np.maximum(tokens, 1),
    ])


def matrix(texts: pa.Array) -> np.ndarray:
    raw, offs = T.buffers(texts)
    parts = [features(raw, offs[lo : hi + 1]) for lo, hi in T.slices(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """(doc_id, text, *columns) of at most ``rows`` labelled documents, chosen by a hash of the id.

    Labels whose first column is null are left out, others may be null; of several
    rows for an id the largest count.
    """
    some = labels.select("doc_id", *columns).dropna(subset=["doc_id", columns[0]]).groupBy("doc_id").agg(*(F.max(c).cast("double").alias(c) for c in columns))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").dropna().join(small(cut(some)), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in an order that doesn't depend on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c) for c in x.T)], ["doc_id", "y", *FEATURES])

    src = labelled(docs, labels, [column], rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(column).alias("y"))
    got = src.mapInArrow(run, "doc_id long, y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    got = got.sort_values(["doc_id", *FEATURES], kind="stable")
    return got[list(FEATURES)].to_numpy(float), (got["y"].to_numpy(float) > 0).astype(float)


def scored(docs: DataFrame, score: Callable[[np.ndarray], np.ndarray], name: str, least: float | None = None) -> DataFrame:
    """``docs`` and the column ``name``; with ``least`` only rows that score so much, without the column.

    Rows pass through as they are, whatever other columns they have.
    """
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = score(matrix(b.column(text)))
            if least is None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])
            elif (s >= least).any():
                yield b.filter(pa.array(s >= least))

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())]) if least is None else docs.schema
    return docs.mapInArrow(run, schema)
