"""Connected components of edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) to (node, root): the smallest node id of each component, for nodes with an edge.

    Alternates large-star and small-star steps: every round hangs a node on the
    smallest neighbour of its neighbours, so the rounds grow with the logarithm
    of a component's size, not with its diameter. Each round is a written
    table; the one before it is deleted.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        parent = cut(e.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("n")))
        # Large star: a's smaller neighbour b gives way to the smallest neighbour of b. A hub b is many rows
        # on the left side only, which adaptive execution can split.
        up = parent.select(F.col("a").alias("k"), "p")
        large = cut(e.join(up, e.b == up.k, "left").select("a", F.coalesce("p", "b").alias("b"), F.col("p").isNotNull().alias("moved")))
        if not large.where("moved").limit(1).count() and not parent.where("n > 1").limit(1).count():
            drop_cut(large)
            drop_cut(e)
            return parent.select(F.col("a").alias("node"), F.col("p").alias("root")).unionByName(parent.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
        # Small star: all smaller neighbours of a, and a, hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("p"))
        both = large.select("a", "b").join(least, "a")
        small = cut(both.select(F.explode(F.array("a", "b")).alias("a"), F.col("p").alias("b")).where("a <> b").distinct())
        for old in (e, parent, large):
            drop_cut(old)
        e = small
