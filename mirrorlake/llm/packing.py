"""Packing documents into windows by order-preserving dynamic programming.

The documents of a shard, in the order of their ids, are one run of sentences.
Windows are stretches of it that end after a sentence, and their ends are chosen
together so that the total cost is least: a token of padding costs ``pad``, one
cut off because a window is over full costs ``truncate``, and an end inside a
document ``split``. With P the running count of tokens, the best last cut i for
an end j minimises either best[i] + pad * P[i] over the windows that fit, which a
monotone queue gives, or best[i] - truncate * P[i] over those that don't, which
is a running minimum; so the whole shard takes linear time.

A shard is ``shard_sentences`` sentences in a row and the rest of the document they
end in, counted over all documents in the order of their ids; so it is as large
however dense the ids are and however large the input is. No window reaches beyond
it. Only counts of tokens are shuffled, never texts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm import text as T
from mirrorlake.operators.lineage import cut

_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
_WIDE_ENDS = [x.encode() for x in "。！？"]


def _stops(data: np.ndarray, after: int) -> np.ndarray:
    """Places after the sentences that end in ``data``; ``after`` is the byte that follows it."""
    stop = np.flatnonzero(_ENDS[data])
    stop = stop[(data[stop] == 10) | T.IS_SPACE[np.append(data, np.uint8(after))[stop + 1]]] + 1
    wide = np.flatnonzero(data[:-2] >= 0xE3)
    if not len(wide):
        return stop
    found = [wide[(data[wide] == a) & (data[wide + 1] == b) & (data[wide + 2] == c)] + 3 for a, b, c in _WIDE_ENDS]
    return np.sort(np.concatenate([stop, *found]))


@dataclass(frozen=True)
class PackOptions:
    """``tokenizer``: path of a tokenizers JSON file; without, a word counts one token
    for each ``piece_bytes`` bytes begun, and each punctuation mark one."""

    window: int = 2048
    pad: float = 1.0
    truncate: float = 2.0
    split: float = 32.0
    shard_sentences: int = 65_536
    piece_bytes: int = 6
    tokenizer: str | None = None


def sentence_tokens(raw: np.ndarray, offs: np.ndarray, o: PackOptions) -> list[np.ndarray]:
    """Tokens of each sentence of each document. A sentence ends after a line, after
    ``.!?`` before white space, or after their wide forms; those without tokens are dropped."""
    n = len(offs) - 1
    at, val, ends = [], [], []
    last = int(offs[-1])
    for pos, piece, start, end in T.runs(raw, offs):
        mark = np.flatnonzero(T.classes(piece) == T.MARK)
        at.append(np.concatenate([start, mark]) + pos)
        val.append(np.concatenate([-(-(end - start) // o.piece_bytes), np.ones(len(mark), np.int64)]))
        ends.append(_stops(piece, int(raw[min(pos + len(piece), last - 1)])) + pos)
    if not at:
        return [np.zeros(0, np.int64)] * n
    place = np.concatenate(at)
    order = np.argsort(place, kind="stable")
    total = np.concatenate([[0], np.cumsum(np.concatenate(val)[order])])
    bound = np.unique(np.concatenate([*ends, offs]))
    tokens = np.diff(total[np.searchsorted(place[order], bound)])
    first = np.searchsorted(bound, offs)
    return [t[t > 0] for t in (tokens[a:b] for a, b in zip(first[:-1], first[1:], strict=True))]


def sentence_spans(text: str) -> list[str]:
    """The sentences that :func:`sentence_tokens` counts, as strings."""
    data = np.frombuffer(text.encode(), np.uint8)
    cut = [0, *_stops(data, 32).tolist(), len(data)]
    return [s for a, b in zip(cut, cut[1:], strict=False) if (s := data[a:b].tobytes().decode())]


def _with_tokenizer(texts: pa.Array, path: str) -> list[np.ndarray]:
    from tokenizers import Tokenizer

    made = _TOKENIZERS.setdefault(path, None) or Tokenizer.from_file(path)
    made.encode_special_tokens = True
    _TOKENIZERS[path] = made
    out = []
    for t in texts:
        counts = np.array([len(e.ids) for e in made.encode_batch(sentence_spans(t.as_py() or ""), add_special_tokens=False)], np.int64)
        out.append(counts[counts > 0])
    return out


_TOKENIZERS: dict[str, object] = {}


def cuts(tokens: np.ndarray, ends_doc: np.ndarray, o: PackOptions) -> tuple[list[int], float]:
    """Ends of the best windows (counts of units before them) and their cost.

    Of equal costs the window that begins first, so the longest, is taken.
    """
    n, cap, pad, over, split = len(tokens), o.window, o.pad, o.truncate, o.split
    P = [0, *np.cumsum(tokens).tolist()]
    last_of = ends_doc.tolist()
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    fits: deque[int] = deque()
    key = [0.0] * (n + 1)
    low, low_at, out = float("inf"), -1, 0
    for j in range(1, n + 1):
        i = j - 1
        key[i] = k = best[i] + pad * P[i]
        while fits and key[fits[-1]] > k:
            fits.pop()
        fits.append(i)
        p = P[j]
        while P[out] < p - cap:  # these starts no longer fit
            v = best[out] - over * P[out]
            if v < low:
                low, low_at = v, out
            out += 1
        while fits and fits[0] < out:
            fits.popleft()
        a = key[fits[0]] + pad * (cap - p) if fits else float("inf")
        b = low + over * (p - cap)
        if b < a or (b == a and low_at < fits[0]):
            a, back[j] = b, low_at
        else:
            back[j] = fits[0]
        best[j] = a + (0.0 if last_of[i] else split)
    ends = []
    j = n
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1], best[n]


def _lengths(docs: DataFrame, o: PackOptions) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                if o.tokenizer:
                    got = _with_tokenizer(b.column(1).slice(lo, hi - lo), o.tokenizer)
                else:
                    got = sentence_tokens(raw, offs[lo : hi + 1], o)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return src.mapInArrow(run, "doc_id long, tokens array<int>")


def _sharded(lengths: DataFrame, o: PackOptions) -> DataFrame:
    """``lengths`` with ``place``, how many sentences stand before the document, and ``shard``.

    A sort by ranges and one sum for each range; rows of one id and equal counts
    are interchangeable, so a number of the row parts them.
    """
    rows = cut(lengths.withColumn("tie", F.xxhash64("tokens"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").drop("row"))
    rows = rows.withColumn("range", F.spark_partition_id()).select("range", "doc_id", "tokens")
    sizes = sorted(rows.groupBy("range").agg(F.sum(F.size("tokens")).alias("n")).collect())  # a row for each partition
    before = dict(zip([r[0] for r in sizes], np.cumsum([0, *(r.n for r in sizes)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for b in batches:
            if not b.num_rows:
                continue
            if place is None:
                place = before[b.column(0)[0].as_py()]
            n = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(at // o.shard_sentences, pa.int64()), pa.array(at, pa.int64()), b.column(1), b.column(2)], ["shard", "place", "doc_id", "tokens"])

    return rows.mapInArrow(run, "shard long, place long, doc_id long, tokens array<int>")


SCHEMA = "shard long, window long, doc_ids array<long>, first_sentence long, last_sentence long, n_tokens long, padding long, truncated long, ends_inside boolean"


def _pack(o: PackOptions) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        rows = list(zip(table["doc_id"].to_pylist(), (x.values.to_numpy(zero_copy_only=False) for x in table["tokens"]), strict=True))
        names = ["shard", "window", "doc_ids", "first_sentence", "last_sentence", "n_tokens", "padding", "truncated", "ends_inside"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.bool_()]
        if not rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, types, strict=True)})
        size = np.array([len(t) for _, t in rows])
        tokens = np.concatenate([np.asarray(t, np.int64) for _, t in rows])
        doc = np.repeat(np.arange(len(rows)), size)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        ends_doc = np.append(doc[1:] != doc[:-1], True)
        ends = np.array(cuts(tokens, ends_doc, o)[0])
        begin = np.concatenate([[0], ends[:-1]])
        total = np.concatenate([[0], np.cumsum(tokens)])
        n = total[ends] - total[begin]
        ids = [r[0] for r in rows]
        shard = table["shard"][0].as_py()
        values = [
            [shard] * len(ends), np.arange(len(ends)), [ids[int(doc[a]) : int(doc[b - 1]) + 1] for a, b in zip(begin, ends, strict=True)],
            nth[begin], nth[ends - 1], n, np.maximum(o.window - n, 0), np.maximum(n - o.window, 0), ~ends_doc[ends - 1],
        ]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, values, types, strict=True)})

    return pack


def pack_documents(docs: DataFrame, options: PackOptions | None = None) -> DataFrame:
    """Windows: which documents each holds, from and to which sentence, and how full it is.

    ``first_sentence`` counts in the first document, ``last_sentence`` in the last.
    Documents without tokens (null, empty, white space) and rows without an id are
    left out. Rows that repeat an id are packed one after the other; ids are whole
    numbers, in any spacing. A sentence
    longer than a window is cut off at its end. No documents give no windows.
    """
    o = options or PackOptions()
    rows = _sharded(_lengths(docs, o).filter(F.size("tokens") > 0), o)
    return rows.groupBy("shard").applyInArrow(_pack(o), SCHEMA)
