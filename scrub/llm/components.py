"""Connected components of a graph whose edges are a DataFrame, by alternating star contraction.

Large-star and small-star steps (Kiveris et al., 2014) in turn: each step hangs neighbours onto the
smallest node near them, until all edges point at the smallest node of their component. The number of
steps grows with the logarithm of the graph. Nothing is collected; a step is two aggregations and
joins, and its edges are written to the shared folder so that the plan doesn't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v: large joins a node's greater neighbours to its smallest, small the others."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that has an edge; component is the smallest node that can be reached.

    ``edges`` has two long columns u and v. Loops, repeated and reversed edges, and nulls in either
    column do no harm; nodes without an edge to another are left out. No edges give no rows.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    while True:
        new = materialize(_star(_star(now, large=True).distinct(), large=False).distinct(), "edges")
        # Both lists are distinct, so equal size and nothing new means equal.
        if new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty():
            break
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
