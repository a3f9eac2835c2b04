"""Near-duplicate search: a chosen-path set similarity join.

After Christiani and Pagh, "Set Similarity Search Beyond MinHash" (2017), and
Christiani, Pagh and Sivertsen, "Scalable and Robust Set Similarity Join" (2018).
A document is the set of its word shingles, embedded as ``TOKENS`` minwise
tokens. Each of several independent trees picks positions at random, on average
``1 / threshold`` at a node, and branches the node's documents by their tokens
there: a pair of the wanted similarity goes on into one child on average, while
unlike pairs part. Nodes of up to ``node_limit`` documents are compared
exhaustively, larger ones branch on.

The first branching is one shuffle of (node, document); nodes of one document end
there, and of small nodes with the same documents one stays. In a node a document
that is surely similar to an earlier one is linked to it and then compared only with
documents outside that cluster, so a group of n copies costs n links, not n * n; a
node all of one cluster ends. Nodes above ``split_rows`` branch again in Spark, after
a comparison with leaders that an aggregate picks, the others inside their task; what
is still too large after ``split_rounds`` is compared in blocks, each pair of blocks a
task of its own. So no task holds more than ``2 * split_rows`` documents.

Pairs whose estimate lies within three standard errors of the threshold are verified
by their exact Jaccard similarity, those beyond are taken as similar; all that is left
out are pairs already in one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mirrorlake.llm import text as T
from mirrorlake.operators.components import components
from mirrorlake.operators.lineage import cut, small

TOKENS = 128


@dataclass(frozen=True)
class NearOptions:
    """``threshold``: similarity of word-shingle sets from which documents count as copies.

    ``trees``: independent repetitions; ``node_limit``, ``split_rows``: documents of nodes
    that are compared whole and of nodes that a task branches; ``leaders``: documents of a
    larger node that all others are compared with before it branches.
    """

    threshold: float = 0.5
    shingle: int = 3
    trees: int = 8
    node_limit: int = 250
    split_rows: int = 20_000
    split_rounds: int = 8
    leaders: int = 8
    seed: int = 7

    @property
    def branches(self) -> int:
        return max(1, round(1 / self.threshold))

    @property
    def error(self) -> float:
        return 3 * (self.threshold * (1 - self.threshold) / TOKENS) ** 0.5


def _multipliers(seed: int, n: int = TOKENS) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _positions(o: NearOptions) -> np.ndarray:
    """The first branching's positions, tree after tree; distinct as far as there are tokens."""
    rng = np.random.default_rng(o.seed + 1)
    need = o.trees * o.branches
    return np.concatenate([rng.permutation(TOKENS) for _ in range(-(-need // TOKENS))])[:need]


def signatures(docs: DataFrame, o: NearOptions) -> DataFrame:
    """(doc_id, whole, sig, nodes) of the documents that have words and an id.

    ``whole`` is the same for equal sequences of shingles, ``sig`` has a byte of
    each minwise token, ``nodes`` the first nodes of all trees.
    """
    at = _positions(o)
    salt = T.mix(np.arange(len(at), dtype=np.uint64) + np.uint64(o.seed << 20))
    mult = _multipliers(o.seed)
    k = o.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            raw, offs = T.buffers(batch.column(1))
            for lo, hi in T.slices(offs):
                sh, place = T.sets(*T.words(raw, offs[lo : hi + 1]), k)
                some = np.flatnonzero(np.diff(place) > 0)
                if not len(some):
                    continue
                begin = place[:-1][some]
                low = np.empty((TOKENS, len(some)), np.uint64)
                for i, m in enumerate(mult):
                    low[i] = np.minimum.reduceat(sh * m, begin)
                low = T.mix(low)
                whole = T.mix(np.add.reduceat(T.mix(sh), begin) + np.diff(place)[some].astype(np.uint64))
                nodes = T.mix(low[at].T ^ salt).astype(np.uint64)
                sig = np.ascontiguousarray((low & np.uint64(255)).astype(np.uint8).T)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(some)),
                        pa.array(T.as_signed(whole)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, nodes.size + 1, nodes.shape[1], dtype=np.int32), pa.array(T.as_signed(nodes.ravel()))),
                    ],
                    ["doc_id", "whole", "sig", "nodes"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).filter("doc_id is not null")
    return src.mapInArrow(run, "doc_id long, whole long, sig binary, nodes array<long>")


def _levels(o: NearOptions) -> tuple[float, float]:
    """Equal bytes of two signatures from which a pair is surely, or maybe, similar."""
    lift = lambda j: (j + (1 - j) / 256) * TOKENS  # noqa: E731  # bytes of different tokens agree once in 256
    return lift(min(o.threshold + o.error, 1 - 1e-9)), lift(max(o.threshold - o.error, 0))


class _Compare:
    """Links inside one node: (a, b, sure), where sure pairs need no verification.

    Inside, documents and clusters are numbers from 0, whatever their ids are.
    """

    def __init__(self, o: NearOptions):
        self.o = o
        self.sure, self.maybe = _levels(o)

    def node(self, ids: np.ndarray, sig: np.ndarray, seed: int, label: np.ndarray | None = None) -> list[tuple]:
        """``label``: id of the document that each is linked to already, its own if to none."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.sig = ids[order].tolist(), sig[order]
        self.out: list[tuple] = []
        known = np.full(len(ids), -1, np.int64)
        if label is not None:
            _, code, count = np.unique(label[order], return_inverse=True, return_counts=True)
            known = np.where((count[code] > 1) | (label[order] != ids[order]), len(ids) + code, -1)
        self._node(np.arange(len(ids)), known, seed, 0)
        return self.out

    def _node(self, at: np.ndarray, label: np.ndarray, seed: int, depth: int) -> None:
        n = len(at)
        if n < 2 or (label[0] >= 0 and (label == label[0]).all()):
            return
        big = n > self.o.node_limit and depth < 24
        label = self._leaders(at, label, self.o.leaders if big else n)
        if not big:
            return
        rng = np.random.default_rng([seed & 0xFFFFFFFF, depth])
        for k in rng.choice(TOKENS, self.o.branches, replace=False):
            token = self.sig[at, k]
            for value in np.flatnonzero(np.bincount(token, minlength=256) > 1):
                pick = np.flatnonzero(token == value)
                if len(pick) == n:  # no progress on this token
                    self._node(at, label, seed * 31 + int(k), depth + 1)
                else:
                    self._node(at[pick], label[pick], seed * 31 + int(k) * 257 + int(value), depth + 1)

    def _leaders(self, at: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
        """Compare documents with those outside their clusters: all, or of more than ``most`` so many that are in none."""
        label = label.copy()
        n, done, ids, sig = len(at), 0, self.ids, self.sig[at]
        for i in range(n):
            if most < n:
                if label[i] >= 0 and label[i] != at[i]:
                    continue
                if done == most:
                    break
                done += 1
            if label[i] < 0:
                label[i] = at[i]
            first = 0 if most < n else i + 1  # with all compared in turn, each pair comes up once
            other = np.flatnonzero(label[first:] != label[i]) + first
            if not len(other):
                continue
            same = (sig[other] == sig[i]).sum(1)
            near, same = other[same >= self.maybe], same[same >= self.maybe]
            for j in near[same >= self.sure].tolist():
                if label[j] == label[i]:  # its cluster is linked by now
                    continue
                self._link(ids[at[i]], ids[at[j]], True)
                if label[j] < 0:
                    label[j] = label[i]
                else:
                    label[label == label[j]] = label[i]
            for j in near[same < self.sure].tolist():
                if label[j] != label[i]:
                    self._link(ids[at[i]], ids[at[j]], False)
        return label

    def _link(self, a: int, b: int, sure: bool) -> None:
        if a != b:  # one id can have several texts
            self.out.append((min(a, b), max(a, b), sure))


def _shared(rows: DataFrame, most: int) -> DataFrame:
    """The (node, doc_id, label) of nodes with documents of several labels, and of equal ones of ``most`` documents only one."""
    mark = F.bit_xor(F.xxhash64("doc_id", "label"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), mark.alias("mark"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("node", "n", "mark")
    nodes = cut(nodes)
    once = nodes.filter(F.col("n") <= most).groupBy("n", "mark").agg(F.min("node").alias("node")).select("node")
    keep = cut(once.unionByName(nodes.filter(F.col("n") > most).select("node")))
    return rows.join(small(keep), "node", "left_semi").select("node", "doc_id", "label")


def _with_leaders(rows: DataFrame, o: NearOptions, depth: int) -> DataFrame:
    """(node, doc_id, label, sig, links) of large nodes, all compared with a few of each that have no label yet.

    Leaders are picked by least hash, so by a partial aggregate; ``links`` are
    (other, sure), and a document surely like a leader takes that one's id as label.
    """
    sure, maybe = _levels(o)
    free = F.col("label") == F.col("doc_id")
    pick = lambda i: F.min_by(F.struct("doc_id", "sig"), F.when(free, F.xxhash64("doc_id", F.lit(depth * 100 + i))))
    leaders = rows.groupBy("node").agg(F.array_compact(F.array(*(pick(i) for i in range(o.leaders)))).alias("l"))
    leaders = cut(leaders.select("node", F.col("l.doc_id").alias("l_ids"), F.col("l.sig").alias("l_sigs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, ids, label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw, offs = T.buffers(b.column(3))
            sig = raw[offs[0] : offs[-1]].reshape(-1, TOKENS)
            label, links = label.copy(), [[] for _ in ids]
            order = np.argsort(node, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                who = b.column(4)[int(own[0])].as_py()
                marks = b.column(5)[int(own[0])].as_py()
                for k, (w, m) in enumerate(zip(who, marks, strict=True)):
                    same = (sig[own] == np.frombuffer(m, np.uint8)).sum(1)
                    for j in own[(same >= maybe) & (ids[own] != w) & (label[own] != w)].tolist():
                        links[j].append((w, bool((sig[j] == np.frombuffer(m, np.uint8)).sum() >= sure)))
                    take = own[(same >= sure) & (label[own] == ids[own]) & (ids[own] != w)]
                    if k:  # a leader follows earlier ones only
                        take = take[~np.isin(ids[take], who[:k])]
                    label[take] = w
            struct = pa.struct([("other", pa.int64()), ("sure", pa.bool_())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label, pa.int64()), b.column(3), pa.array([[{"other": w, "sure": s} for w, s in x] for x in links], pa.list_(struct))], ["node", "doc_id", "label", "sig", "links"])

    both = rows.join(small(leaders), "node").select("node", "doc_id", "label", "sig", "l_ids", "l_sigs")
    return cut(both.mapInArrow(run, "node long, doc_id long, label long, sig binary, links array<struct<other: long, sure: boolean>>"))


def _split(live: DataFrame, reps: DataFrame, o: NearOptions) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes of ``split_rows`` documents at most, and the (a, b, sure) found on the way."""
    links: list[DataFrame] = []
    for depth in range(o.split_rounds + 1):
        sizes = cut(live.groupBy("node").count().filter(F.col("count") > o.split_rows))
        if not sizes.take(1):
            break
        big = live.join(small(sizes), "node").select(*live.columns, "count")
        rest = live.join(small(sizes.select("node")), "node", "left_anti").select(live.columns)
        if depth == o.split_rounds:  # each pair of blocks is a node of its own
            blocks = F.ceil(F.col("count") / o.split_rows).cast("long")
            own = F.pmod(F.xxhash64("doc_id", "node"), blocks)
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: F.xxhash64("node", F.least(own, i), F.greatest(own, i)))
            live = cut(rest.unionByName(big.select(F.explode(pairs).alias("node"), "doc_id", "label")))
            break
        rows = cut(big.select("node", "doc_id", "label").join(reps.select("doc_id", "sig"), "doc_id"))
        rows = _with_leaders(rows, o, depth)
        found = rows.select("doc_id", F.explode("links").alias("e"))
        links.append(found.select(F.least("doc_id", "e.other").alias("a"), F.greatest("doc_id", "e.other").alias("b"), "e.sure"))
        at = [F.pmod(F.xxhash64("node", F.lit(depth * 100 + i)), F.lit(TOKENS)).cast("int") + 1 for i in range(o.branches)]
        kids = F.array_distinct(F.array(*(F.xxhash64("node", p, F.substring("sig", p, 1)) for p in at)))
        kids = _shared(rows.select(F.explode(kids).alias("node"), "doc_id", "label"), o.node_limit)
        live = cut(rest.unionByName(kids))
    return live, links


def candidate_links(reps: DataFrame, o: NearOptions) -> DataFrame:
    """(a, b, sure) from all nodes of all trees."""
    first = reps.select("doc_id", F.explode("nodes").alias("node")).withColumn("label", F.col("doc_id"))
    live, links = _split(cut(_shared(first, o.node_limit)), reps, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = _Compare(o)
        rest: tuple | None = None

        def inside(node: np.ndarray, ids: np.ndarray, label: np.ndarray, sig: np.ndarray) -> list[tuple]:
            found: list[tuple] = []
            if not len(node):
                return found
            edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            same = np.where(label[two] == label[two + 1], -1, (sig[two] == sig[two + 1]).sum(1))
            for p in (same >= compare.maybe).nonzero()[0].tolist():
                a, b = ids[two[p]], ids[two[p] + 1]
                found.append((min(a, b), max(a, b), bool(same[p] >= compare.sure)))
            for p in np.flatnonzero(size > 2).tolist():
                lo, hi = edge[p], edge[p + 1]
                found += compare.node(ids[lo:hi], sig[lo:hi], int(node[lo]), label[lo:hi])
            return found

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            found = [f for f in dict.fromkeys(found) if f[0] != f[1]]
            return pa.RecordBatch.from_arrays([pa.array([int(f[0]) for f in found], pa.int64()), pa.array([int(f[1]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.bool_())], ["a", "b", "sure"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offs = T.buffers(batch.column(3))
            now = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), raw[offs[0] : offs[-1]].reshape(-1, TOKENS))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            node = now[0]
            last = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
            rest = tuple(x[last:].copy() for x in now)
            if found := inside(*(x[:last] for x in now)):
                yield batch_of(found)
        if rest is not None and (found := inside(*rest)):
            yield batch_of(found)

    rows = live.join(reps.select("doc_id", "sig"), "doc_id").select("node", "doc_id", "label", "sig")
    rows = rows.repartition("node").sortWithinPartitions("node")
    found = rows.mapInArrow(run, "a long, b long, sure boolean")
    for more in links:
        found = found.unionByName(more)
    return found.distinct()


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, whole, shingles) with each shingle once, and a number of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = T.buffers(batch.column(1))
            for lo, hi in T.slices(offs):
                sh, place = T.sets(*T.words(raw, offs[lo : hi + 1]), k)
                each = [np.unique(T.as_signed(sh[a:b])) for a, b in zip(place[:-1], place[1:], strict=True)]
                whole = [int(np.bitwise_xor.reduce(T.mix(x.view(np.uint64)))) >> 1 if len(x) else 0 for x in each]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(whole, pa.int64()), pa.array(each, pa.list_(pa.int64()))], ["doc_id", "whole", "shingles"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).filter("doc_id is not null")
    return src.mapInArrow(run, "doc_id long, whole long, shingles array<long>")


def verified(pairs: DataFrame, docs: DataFrame, o: NearOptions) -> DataFrame:
    """Those of the (a, b) whose exact Jaccard similarity reaches the threshold, with any of the texts an id has."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(cut(ids)), "doc_id", "left_semi")
    sets = cut(shingle_sets(wanted, o.shingle).groupBy("doc_id", "whole").agg(F.first("shingles").alias("shingles")))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(both >= o.threshold * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def near_groups(docs: DataFrame, options: NearOptions | None = None) -> DataFrame:
    """(doc_id, duplicate_of): each document that is a copy, and the least id of its group.

    Groups are the connected components of pairs whose word-shingle sets have a
    Jaccard similarity of ``threshold`` or more; the document that gives a group
    its id has no row. Documents without words (null, empty, punctuation only) or
    without an id are in no group. Texts of fewer words than a shingle are one
    shingle. Rows that repeat a doc_id are one document. No table, no rows.
    """
    o = options or NearOptions()
    sigs = cut(signatures(docs, o))
    groups = sigs.groupBy("whole").agg(F.min_by(F.struct("sig", "nodes"), "doc_id").alias("r"), F.min("doc_id").alias("doc_id"))
    reps = cut(groups.select("doc_id", "whole", "r.sig", "r.nodes"))
    copies = sigs.select("whole", F.col("doc_id").alias("b")).join(reps.select("whole", F.col("doc_id").alias("a")), "whole").filter("a <> b").select("a", "b").distinct()
    links = cut(candidate_links(reps, o))
    sure = links.filter("sure").select("a", "b")
    first = cut(components(copies.unionByName(sure)))
    side = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(c + "_in"))
    open_ = links.filter("not sure").join(side("a"), "a", "left").join(side("b"), "b", "left")
    a_in, b_in = F.coalesce("a_in", "a"), F.coalesce("b_in", "b")
    open_ = cut(open_.filter(a_in != b_in).select("a", "b").distinct())
    extra = cut(verified(open_, docs, o)) if open_.take(1) else open_
    if extra.take(1):
        stars = first.select(F.col("component").alias("a"), F.col("node").alias("b"))
        first = components(stars.unionByName(extra))
    return first.filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("duplicate_of"))


def drop_near(docs: DataFrame, options: NearOptions | None = None) -> DataFrame:
    """``docs`` with one document of each group, that of the least id, and each id once.

    Rows without an id or words stay. Of rows that repeat an id that with the least
    text stays, and of those the one whose other columns come first.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    twice = cut(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = near_groups(docs, options).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    kept = docs.join(small(cut(gone)), "doc_id", "left_anti").select(docs.columns)
    if not twice.take(1):
        return kept
    again = small(twice)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct("text", *(F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("text", "doc_id") and _ordered(f.dataType)))
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("r")).select("r.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def _ordered(kind: DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()
