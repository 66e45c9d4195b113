"""Connected components of an edge table by repeated contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of a component
    share their root, which is one of them.

    Each round every node takes the neighbour (or itself) that comes first in
    an order drawn anew, follows that choice once more, and the edges are
    contracted. A constant share of the nodes goes in each round whatever
    their numbering, so the rounds grow with the logarithm of the input.
    A node with any number of neighbours is a map-side aggregate and a join
    that adaptive execution can split; nothing is collected.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a < b").distinct(), narrow=True)
    roots, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        chosen = materialise(both.groupBy("a").agg(F.min(order("b")).alias("other"))
                             .select(F.col("a").alias("node"), F.least(order("a"), "other")["n"].alias("up")), narrow=True)
        step = chosen.join(chosen.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root")
        if roots is None:
            roots = step
        else:
            on = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = roots.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = materialise(roots, narrow=True)
        step = materialise(step, narrow=True)
        edges = (edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
                 .join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        edges = materialise(edges, narrow=True)
        turn += 1
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
