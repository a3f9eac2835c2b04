"""Quality classifier: a generalised additive model with pairwise interactions.

After Lou et al., "Accurate Intelligible Models with Pairwise Interactions"
(2013). Shallow trees, each on one feature's bins, are boosted in turn over the
features; a tree only ever adds to its feature's lookup table. Then the pairs
with the largest gain on the residuals get tables of two features the same way.
Scoring is a search for bins and a sum of table entries, for a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm import docstats


@dataclass(frozen=True)
class GamOptions:
    """``sample_rows`` bounds the labelled documents that the model is fitted to."""

    sample_rows: int = 20_000
    bins: int = 64
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 6
    pair_bins: int = 12
    rate: float = 0.1
    ridge: float = 2.0
    threshold: float = 0.5


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """A tree of ``depth`` over bins with these gradients and weights: what it adds to each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(a, b, ridge) + _gain(g.sum() - a, h.sum() - b, ridge)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            out[:cut] = _leaves(g[:cut], h[:cut], ridge, depth - 1)
            out[cut:] = _leaves(g[cut:], h[cut:], ridge, depth - 1)
    return out


def _pair_leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut of the first feature with one of the second on either side; with its gain."""
    best, out = -1.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        total, table = 0.0, np.zeros_like(g)
        for part in (slice(0, cut), slice(cut, None)):
            a, b = g[part].sum(0), h[part].sum(0)
            line = _leaves(a, b, ridge, 1)
            table[part] = line
            total += float((line * a - 0.5 * line * line * b).sum())
        if total > best:
            best, out = total, table
    return out, best


@dataclass
class Gam:
    """Bias, one table for each feature and one for each pair; all in log-odds."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, ei, ej, t in self.pairs:
            out += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, o: GamOptions | None = None) -> Gam:
    """A model of P(y = 1). Without rows it says one half, with one class nearly that class."""
    o = o or GamOptions()
    n, m = len(x), x.shape[1]
    rate = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate))) if n else 0.0
    edges = [_edges(x[:, j], o.bins) for j in range(m)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return Gam(bias, edges, tables, [])
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    f = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(o.rounds):
        for j in range(m):
            g, h = slopes()
            size = len(tables[j])
            step = o.rate * _leaves(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), o.ridge, 2)
            tables[j] += step
            f += step[bins[j]]
    coarse = [_edges(x[:, j], o.pair_bins) for j in range(m)]
    cbins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(v: np.ndarray, i: int, j: int) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cbins[i] * b + cbins[j], v, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(combinations(range(m), 2), key=lambda p: -_pair_leaves(grid(g, *p), grid(h, *p), o.ridge)[1])[: o.pairs]
    found = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(o.pair_rounds):
        for (i, j), table in found.items():
            g, h = slopes()
            step = o.rate * _pair_leaves(grid(g, i, j), grid(h, i, j), o.ridge)[0]
            table += step
            f += step[cbins[i], cbins[j]]
    return Gam(bias, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in found.items()])


def quality_scores(docs: DataFrame, labels: DataFrame, options: GamOptions | None = None) -> DataFrame:
    """(doc_id, quality, keep) for each row of ``docs``: P(good) and whether it reaches the threshold.

    Null and empty texts are scored by their statistics, all zero, like others;
    without labelled rows every document gets one half and is kept. Repeated rows
    get the same score; rows without an id keep a null id. Other columns are ignored.
    """
    o = options or GamOptions()
    model = fit(*docstats.sample(docs, labels, "quality", o.sample_rows), o)
    rows = docstats.scored(docs.select("doc_id", "text"), model.probability, "quality")
    return rows.select("doc_id", "quality", (F.col("quality") >= o.threshold).alias("keep"))


def quality_keep(docs: DataFrame, labels: DataFrame, options: GamOptions | None = None) -> DataFrame:
    """The rows of :func:`quality_scores` that are kept."""
    return quality_scores(docs, labels, options).filter("keep")
