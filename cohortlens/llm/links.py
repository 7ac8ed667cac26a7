"""Connected components of an undirected graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = around.where("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node that has a link to another.

    Only minima per node are gathered, which combine before the shuffle; a node with very many
    links is one row on the other side of a join that adaptive execution can split. Each round is
    written to the shared folder. Nodes without links, null nodes and loops give no row; repeated
    links are harmless; no links give an empty table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    last = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))
        ).first()
        if state == last:
            break
        last = state
        edges = stored(_small_star(stored(_large_star(edges), "links")), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
