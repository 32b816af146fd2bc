"""Connected components of an edge table, by alternating star contractions.

Each round links every node's larger neighbours to its smallest neighbour, then every node and its smaller
neighbours to the smallest of them; the edges end as stars around each component's smallest node after a number
of rounds that grows with the logarithm of the size. Every round is two aggregations and two joins, and is
written to the shared folder, so a lost executor costs one round at most. Nothing is collected: the driver sees
one count and one checksum a round.

A hub, the node of very many edges, is no bottleneck: its least neighbour is found by partial minima, and those are
written too, so that the join which brings them back to the edges is one of two plain exchanges. Adaptive execution
can split a crowded node's edges only there, not where one side is the aggregation itself. Minima are broadcast only after
a count: their file is far smaller than the table that the driver would build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.session import broadcast_or_merge, materialize


def _towards_smallest(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours point to the smallest node among itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    return both.filter("b > a").join(broadcast_or_merge(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _onto_smallest(edges: DataFrame) -> DataFrame:
    """For each node, it and its smaller neighbours point to the smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(broadcast_or_merge(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the edges (``a``, ``b``).

    Nodes without an edge to another node are not in the result. Repeated edges and loops do no harm.
    """
    edges = materialize(edges.filter("a <> b").distinct())
    seen = None
    while True:
        turned = materialize(_towards_smallest(edges))  # read twice by the second half of the round
        edges = materialize(_onto_smallest(turned).filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = tuple(now)
