"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node reachable from node. No edges, no rows.

    Each round every node takes the smallest root among its own and its neighbours' and then that root's root (pointer
    jumping), so rounds grow with the logarithm of the longest path. Every round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    roots = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    last = roots
    while True:
        near = (
            both.join(roots, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("root").alias("near"))
            .join(roots, F.col("a") == F.col("node"))
            .select("node", F.col("root").alias("was"), F.least("near", "root").alias("root"))
        )
        # A root is a node itself, whose root may be smaller by now.
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = written(near.join(up, "root").select("node", F.least("root", "up").alias("root"), (F.least("root", "up") < F.col("was")).alias("moved")), "roots")
        freed(last)
        last = moved
        roots = moved.select("node", "root")
        if not moved.where("moved").take(1):
            freed(both)
            return roots
