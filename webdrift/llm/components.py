"""Connected components by alternating star steps.

Edges are (u, v), keys of any orderable type.  A large star points the larger neighbours of a
node to its smallest neighbour, a small star the smaller ones and the node itself; both keep the
components and never make more edges than there were.  Smallest neighbours are found by a
partial aggregation and joined back, so a node with very many neighbours is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdrift.llm.common import checkpointed


def _toward_smallest(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u.  One step; the result has v < u again.

    The smallest neighbours are written before the join: it then shuffles both sides for itself,
    and adaptive execution can split a node with very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(checkpointed(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))
        moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest key of each node's component, for the nodes of ``edges`` (u, v).

    Nodes are not null; edges of a node to itself are left out, and repeated ones count once.
    """
    edges = checkpointed(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(edges)
    while before[0]:
        edges = checkpointed(_toward_smallest(_toward_smallest(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
