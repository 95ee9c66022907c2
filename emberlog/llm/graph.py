"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component is named by its least node.

    Nodes are of any one ordered type. Loops, repeated edges and either direction are fine; edges
    with a null end are dropped; no edges give no rows. Alternating star steps: each node links
    its greater neighbours to the least node around it, then itself and its smaller neighbours
    likewise. The least neighbour is an aggregate and reaches the edges by a join, so the
    neighbours of a hub are never gathered in one place. Steps are checkpointed; there are about
    log(longest path) of them."""
    known = edges.where("a is not null and b is not null")
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    links = checkpoint(known.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct())
    mark = _mark(links)
    while mark[0]:
        links = checkpoint(_small_star(_large_star(links)))
        before, mark = mark, _mark(links)
        if before == mark:
            break
    return nodes.join(links, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(links: DataFrame) -> tuple:
    """Tells one set of links from another: their number and the sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of the node and its neighbours."""
    both = links.union(links.select("component", "node")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("node"), "component").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = links.groupBy("node").agg(F.min("component").alias("least"))
    moved = links.join(least, "node").where("component <> least").select("component", "least")
    return least.union(moved).toDF("node", "component").distinct()
