"""Toxicity: a classifier chain over word-presence features.

After Read et al., "Classifier Chains for Multi-label Classification" (2009). The
categories are predicted in a fixed order; each linear model sees the words and
the probabilities of the categories before it. To train it, those probabilities
come from models that had not seen the document (folds), so that later models
learn how far earlier ones can be trusted.

The labels are "toxic" and the quality of a document: the chain predicts "toxic", then
"low_quality", then "hostile_junk", which is both. A document whose quality is not
labelled takes part in the first only. The vocabulary is learned: the words and
beginnings of words of the labelled sample with the largest chi-squared statistic,
beginnings both as seen and as seen several times, for languages that inflect and
compound. The models that predict for a fold have a vocabulary of their own, from the
other folds. Near copies count once there, else the words of a toxic document that was
copied would seem toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm import text as T
from mirrorlake.llm.docstats import labelled
from mirrorlake.operators.lineage import cut

CATEGORIES = ("toxic", "low_quality", "hostile_junk")


@dataclass(frozen=True)
class ToxicityOptions:
    """``sample_rows`` bounds the labelled documents that the chain is fitted to.

    ``vocabulary`` bounds its features: the best of those that ``least_documents`` of the
    sample have and whose chi-squared statistic reaches ``least_chi2``.
    """

    sample_rows: int = 20_000
    vocabulary: int = 300
    least_documents: int = 4
    least_chi2: float = 16.0
    folds: int = 5
    ridge: float = 0.1
    threshold: float = 0.5


#: Bytes of the beginnings of longer words, and how often one must be seen to count as frequent.
BEGINNINGS = (4, 6, 8)
OFTEN = 3
_BEGINS, _FREQUENT = np.uint64(2), np.uint64(1)  # the lowest bits of a feature's hash


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word and of its beginnings, marked in the lowest bits."""
    out, docs = [], []
    for pos, piece, start, end in T.runs(raw, offs):
        doc = np.searchsorted(offs, start + pos, "right") - 1
        out.append(T.hashes(piece, start, end) & ~np.uint64(3))
        docs.append(doc)
        for k in BEGINNINGS:
            longer = np.flatnonzero(end - start > k)
            out.append(T.hashes(piece, start[longer], start[longer] + k) & ~np.uint64(3) | _BEGINS)
            docs.append(doc[longer])
    return (np.concatenate(out), np.concatenate(docs)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def features(token: np.ndarray) -> np.ndarray:
    """Distinct features of one document: its tokens, and beginnings that are frequent in it."""
    each, n = np.unique(token, return_counts=True)
    often = each[(n >= OFTEN) & (each & _BEGINS > 0)] | _FREQUENT
    return np.union1d(each, often)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic regression, the last one the bias, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """``vocabulary``: sorted hashes of features; one weight vector for each category."""

    vocabulary: np.ndarray
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """[document, category] of probabilities from [document, word] of presence."""
        for w in self.weights:
            x = np.column_stack([x, _apply(x, w)])
        return x[:, len(self.vocabulary) :]

    def presence(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        base = np.unique(self.vocabulary & ~_FREQUENT)
        count = np.zeros((len(offs) - 1, len(base)))
        if not len(base):
            return count
        token, doc = tokens(raw, offs)
        at = np.minimum(np.searchsorted(base, token), len(base) - 1)
        hit = base[at] == token
        np.add.at(count, (doc[hit], at[hit]), 1)
        need = np.where(self.vocabulary & _FREQUENT > 0, OFTEN, 1)
        return (count[:, np.searchsorted(base, self.vocabulary & ~_FREQUENT)] >= need).astype(float)


#: Says no to everything.
_SILENT = Chain(np.zeros(0, np.uint64), [np.array([-30.0]), np.array([0.0, -30.0]), np.array([0.0, 0.0, -30.0])])


def fit(x: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray, o: ToxicityOptions, fold: np.ndarray | None = None, own: list[np.ndarray] | None = None) -> Chain:
    """A chain from presence [document, word] and labels [document, category], nan where unknown.

    ``own``: columns of the model and then of those of each fold; all by default.
    """
    fold = np.arange(len(x)) % o.folds if fold is None else fold
    own = own or [np.arange(x.shape[1])] * (o.folds + 1)
    weights, before = [], np.zeros((len(x), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        known = ~np.isnan(y)
        seen = lambda k, rows: np.column_stack([x[rows][:, own[k]], before[rows]])  # noqa: B023, E731
        weights.append(_logistic(seen(0, known), y[known], o.ridge))
        unseen = np.zeros(len(x))
        for k in range(o.folds):
            rest = known & (fold != k)
            if (fold == k).any():
                unseen[fold == k] = _apply(seen(k + 1, fold == k), _logistic(seen(k + 1, rest), y[rest], o.ridge))
        before = np.column_stack([before, unseen])
    return Chain(vocabulary[own[0]], weights)


def _bags(docs: DataFrame, labels: DataFrame, o: ToxicityOptions) -> DataFrame:
    """(doc_id, toxic, bad, words, sketch): the distinct features of the sample.

    Near copies have one of the numbers in ``sketch`` in common, each made of four
    minwise words.
    """
    mult = np.random.default_rng(3).integers(1, 2**63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(bag: np.ndarray) -> list[int]:
        if not len(bag):
            return []
        low = np.array([(bag * m).min() for m in mult], np.uint64)
        return [hash(tuple(low[i : i + 4].tolist())) for i in (0, 4, 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                token, doc = tokens(raw, offs[lo : hi + 1])
                order = np.argsort(doc, kind="stable")
                edge = np.searchsorted(doc[order], np.arange(hi - lo + 1))
                bags = [features(token[order[i:j]]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                words = [sketch(x[x & _BEGINS == 0]) for x in bags]
                rest = [b.column(c).slice(lo, hi - lo) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([T.as_signed(x) for x in bags], pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "toxic", "bad", "words", "sketch"])

    src = labelled(docs, labels, ["toxic", "quality"], o.sample_rows)  # quality may be null
    src = src.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), F.col("toxic").cast("double").alias("toxic"), (F.col("quality") <= 0).cast("double").alias("bad"))
    return src.mapInArrow(run, "doc_id long, toxic double, bad double, words array<long>, sketch array<long>")


def _once(bags: DataFrame) -> DataFrame:
    """``bags`` without near copies; at most ``sample_rows`` ids come to the driver."""
    seen: set[int] = set()
    again: list[int] = []
    for r in sorted(bags.select("doc_id", "sketch").collect()):
        if seen.isdisjoint(r.sketch):
            seen.update(r.sketch)
        else:
            again.append(r.doc_id)
    if not again:
        return bags
    gone = bags.sparkSession.createDataFrame([(i,) for i in again], "doc_id long")
    return bags.join(F.broadcast(gone), "doc_id", "left_anti")


def train(docs: DataFrame, labels: DataFrame, o: ToxicityOptions) -> Chain:
    """The chain fitted to the sample; without toxic or without other rows it flags nothing."""
    bags = cut(_bags(docs, labels, o))
    bags = _once(bags)
    n, pos = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if not 0 < pos < n:
        return _SILENT
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(o.folds)).cast("int")
    bags = cut(bags.withColumn("fold", fold))
    word = bags.select("toxic", "fold", F.explode("words").alias("word"))
    inside = [F.col("fold") == f for f in range(o.folds)]
    sums = [x for f, w in enumerate(inside) for x in (F.count(F.when(w, 1)).alias(f"n{f}"), F.sum(F.when(w, F.col("toxic")).otherwise(0.0)).alias(f"k{f}"))]
    each = cut(word.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"), *sums).filter(F.col("n") >= o.least_documents))
    sizes = {r.fold: (r.n, r.k) for r in bags.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()}

    def best(f: int) -> DataFrame:
        """The vocabulary of the model, f being -1, or of the one that predicts for fold f."""
        out = sizes.get(f, (0, 0.0))
        all_, toxic = n - out[0], pos - out[1]
        m, k = (F.col("n") - F.col(f"n{f}"), F.col("k") - F.col(f"k{f}")) if f >= 0 else (F.col("n"), F.col("k"))
        off = k * (all_ - toxic) - (m - k) * toxic
        chi = off * off * all_ / (m * (all_ - m) * toxic * (all_ - toxic) + 1e-9)
        return each.select("word", chi.alias("chi"), m.alias("m")).filter((F.col("m") >= o.least_documents) & (F.col("chi") >= o.least_chi2)).orderBy(F.desc("chi"), "word").limit(o.vocabulary).select("word", F.lit(f).alias("f"))

    top = best(-1)
    for f in range(o.folds):
        top = top.unionByName(best(f))
    top = top.toPandas()
    if not (top["f"] == -1).any():
        return _SILENT
    vocabulary = np.unique(top["word"].to_numpy(np.int64).view(np.uint64))
    own = [np.flatnonzero(np.isin(vocabulary, top.loc[top["f"] == f, "word"].to_numpy(np.int64).view(np.uint64))) for f in range(-1, o.folds)]
    wanted = F.array_intersect("words", F.array(*(F.lit(int(w)) for w in vocabulary.view(np.int64))))
    rows = bags.select("doc_id", "toxic", "bad", "fold", wanted.alias("words")).toPandas().sort_values("doc_id", kind="stable")
    x = np.zeros((len(rows), len(vocabulary)))
    for i, w in enumerate(rows["words"]):
        x[i, np.searchsorted(vocabulary, np.asarray(w, np.int64).view(np.uint64))] = 1
    toxic, bad = (rows["toxic"].to_numpy(float) > 0).astype(float), rows["bad"].to_numpy(float)
    return fit(x, np.column_stack([toxic, bad, toxic * bad]), vocabulary, o, rows["fold"].to_numpy(), own)


def toxicity_scores(docs: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None) -> DataFrame:
    """(doc_id, toxic, low_quality, hostile_junk): probabilities for each row of ``docs``.

    Whole texts are read. A null or empty text has no words and gets the rate of
    such texts; repeated rows get equal results, and rows without an id keep a null
    id. Ids are whole numbers. Other columns are ignored.
    """
    o = options or ToxicityOptions()
    chain = train(docs, labels, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = T.buffers(b.column(1))
            for lo, hi in T.slices(offs):
                p = chain.predict(chain.presence(raw, offs[lo : hi + 1]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c) for c in p.T)], ["doc_id", *CATEGORIES])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))


def toxic_documents(docs: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None) -> DataFrame:
    """The rows of :func:`toxicity_scores` that are toxic: P(toxic) reaches the threshold."""
    o = options or ToxicityOptions()
    return toxicity_scores(docs, labels, o).filter(F.col("toxic") >= o.threshold)
