"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.lineage import cut_lineage
from tallyspark.operators.joins import counted_join


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours.

    A node with more neighbours than a partition's share is joined by broadcast, so a star's hub fills no task. The
    minima are shuffled once for all branches of that join.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = F.count(F.when(F.col("v") > F.col("u"), 1))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), larger.alias("n")).where("n > 0")
    return counted_join(both.where("v > u"), least, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = counted_join(edges, least.where("n > 1"), ["u"], "n", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; the component is its smallest node.

    Large-star and small-star steps alternate until the edges stop changing, which takes about the logarithm
    of the longest path. Minima are combined before each shuffle and no adjacency list is ever collected, so a
    node with very many neighbours stays spread out, in the joins too. Each step is checkpointed. Edges with a null end are
    left out; a node whose only edge is a loop is its own component; an empty table gives no rows.
    """
    a, b = F.col(source), F.col(target)
    given = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    given = cut_lineage(given)
    current, seen = given.where("u > v"), None
    total = current.count()
    for _ in range(rounds):
        current = cut_lineage(_large_star(current, total))
        current = cut_lineage(_small_star(current, total))
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, total = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(current, nodes.node == current.u, "left").select("node", F.coalesce("v", "node").alias("component"))
