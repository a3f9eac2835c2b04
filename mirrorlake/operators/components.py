"""Connected components by alternating large-star and small-star contraction.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): both
steps only ever link nodes to smaller ones of their component, so the edges turn
into stars around the least node in a number of rounds that grows with the
logarithm of the input. The least neighbour of each node is a partial aggregate and
comes back by a join, which Spark can split where a node has very many neighbours;
no adjacency list is ever held in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.operators.lineage import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    seen = down.join(down.groupBy("a").agg(F.min("b").alias("m")), "a")
    links = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return seen.select(F.explode(links).alias("e")).select("e.*").filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) for each node of an edge, component being its least node.

    Edges with a null end are ignored; a self-loop gives a component of one.
    Direction, repeats and order of the edges don't matter.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, mark = pairs.filter("a <> b"), None
    for _ in range(rounds):
        now = cut(_small(_large(now)))
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return roots.join(nodes, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
