"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletags.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b).

    Each round every node moves to the neighbour (or itself) that is first in an order
    drawn anew for the round, edges move along, and those inside one node vanish. The
    order is drawn by a hash, so the number of nodes falls by a constant factor per
    round whatever the shape of the graph. The first neighbour is found by map-side
    aggregation, so a hub costs one row per task. `root` is one node of the component,
    the same for all of them.
    """
    edges = written(_proper(edges))
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("to"))
        moves = written(
            both.groupBy("a").agg(F.min(order).alias("first"))
            .select(F.col("a").alias("node"), F.least("first", own)["to"].alias("to"))
        )
        if labels is None:
            labels = moves.select("node", F.col("to").alias("root"))
        else:
            labels = written(
                labels.join(moves.select(F.col("node").alias("root"), "to"), "root", "left")
                .select("node", F.coalesce("to", "root").alias("root"))
            )
        ends = (
            edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        edges = written(_proper(ends))
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _proper(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller end first, without loops."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
