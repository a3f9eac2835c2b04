"""Quality rules: gradient-boosted trees over document statistics.

Newton boosting on histograms. A feature may be constrained to be monotone: splits
against its direction are refused, and a constrained split bounds the leaves below
it by the middle of its sides, so the whole tree keeps the direction. The ensemble
is flattened into numpy node arrays, and a batch descends all trees level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.llm import docstats

#: More of these never makes a document better.
FALLING = ("symbol_share", "line_repeats", "gram_repeats", "mark_words", "bare_words")


@dataclass(frozen=True)
class RuleOptions:
    """``sample_rows`` bounds the labelled documents that the trees are fitted to."""

    sample_rows: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least_weight: float = 1.0
    threshold: float = 0.5
    directions: tuple[tuple[str, int], ...] = field(default=tuple((f, -1) for f in FALLING))


@dataclass
class Forest:
    """Node arrays of all trees; a leaf is its own child. ``roots`` are where trees begin."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.log_odds(x[i : i + 4096]), -30, 30))) for i in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, o: RuleOptions | None = None, names: tuple[str, ...] = docstats.FEATURES) -> Forest:
    """A forest for P(y = 1). Without rows it says one half, with one class nearly that class."""
    o = o or RuleOptions()
    n, m = x.shape
    sign = np.array([dict(o.directions).get(f, 0) for f in names])
    rate = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate))) if n else 0.0
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and y.min() < y.max():
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, o.bins + 1)[1:-1])) for j in range(m)]
        bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        f = np.full(n, bias)

        def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
            G, H = g[rows].sum(), h[rows].sum()
            at = len(nodes)
            mid = float(np.clip(G / (H + o.ridge), low, high))
            nodes.append([0, np.inf, at, at, mid * o.rate])
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(m if depth else 0):
                size = len(edges[j]) + 1
                b = bins[rows, j]
                a, w = np.bincount(b, g[rows], size).cumsum()[:-1], np.bincount(b, h[rows], size).cumsum()[:-1]
                if not len(a):
                    continue
                lv, rv = np.clip(a / (w + o.ridge), low, high), np.clip((G - a) / (H - w + o.ridge), low, high)
                worth = lambda v, s, t: v * s - 0.5 * v * v * (t + o.ridge)
                gain = worth(lv, a, w) + worth(rv, G - a, H - w) - worth(mid, G, H)
                gain[(w < o.least_weight) | (H - w < o.least_weight) | (sign[j] * (rv - lv) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(lv[k]), float(rv[k]))
            _, j, k, lv, rv = best
            if j >= 0:
                go = bins[rows, j] <= k
                half = (lv + rv) / 2
                l_low, l_high, r_low, r_high = low, high, low, high
                if sign[j] > 0:
                    l_high = r_low = half
                elif sign[j] < 0:
                    l_low = r_high = half
                left = grow(rows[go], depth - 1, l_low, l_high)
                right = grow(rows[~go], depth - 1, r_low, r_high)
                nodes[at][:4] = [j, edges[j][k], left, right]
            else:
                f[rows] += nodes[at][4]
            return at

        for _ in range(o.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            roots.append(grow(np.arange(n), o.depth, -4.0, 4.0))
    c = np.array(nodes, float).reshape(-1, 5)
    return Forest(bias, c[:, 0].astype(int), c[:, 1], c[:, 2].astype(int), c[:, 3].astype(int), c[:, 4], np.array(roots, int), o.depth)


def model(docs: DataFrame, labels: DataFrame, o: RuleOptions) -> Forest:
    return fit(*docstats.sample(docs, labels, "quality", o.sample_rows), o)


def rule_scores(docs: DataFrame, labels: DataFrame, options: RuleOptions | None = None) -> DataFrame:
    """(doc_id, score, keep) for each row of ``docs``.

    Null and empty texts are scored by their statistics, all zero; without
    labelled rows all get one half and are kept. Repeated rows get the same score.
    """
    o = options or RuleOptions()
    rows = docstats.scored(docs.select("doc_id", "text"), model(docs, labels, o).probability, "score")
    return rows.select("doc_id", "score", (F.col("score") >= o.threshold).alias("keep"))


def rules_keep(docs: DataFrame, labels: DataFrame, options: RuleOptions | None = None) -> DataFrame:
    """The rows of :func:`rule_scores` that are kept."""
    return rule_scores(docs, labels, options).filter("keep")


def drop_bad(docs: DataFrame, labels: DataFrame, options: RuleOptions | None = None) -> DataFrame:
    """``docs``, all columns as they are, without the rows that the trees reject."""
    o = options or RuleOptions()
    return docstats.scored(docs, model(docs, labels, o).probability, "score", o.threshold)
