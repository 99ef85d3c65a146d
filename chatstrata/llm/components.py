"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge (a, b), the smallest node that it is connected with.

    Each round hangs every node's neighbours on the least of them, first the larger ones, then
    the smaller ones; the number of rounds grows with the logarithm of the longest path. Rounds
    are written to the shared folder. Nodes are longs; no edges give no rows.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current = staged(current, "edges")
    before = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the joins have exchanges of their own and Spark can split a node with many neighbours
        least = staged(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = staged(large.where("a != b").distinct(), "large-star")
        least = staged(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        current = staged(small.where("a != b").distinct(), "small-star")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
