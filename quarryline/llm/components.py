"""Connected components of a link table by repeated contraction.

Each round maps every node to the smallest id among its neighbours and itself
and rewrites the links between the mapped nodes. Only local minima remain, at
most half of the linked nodes, so the rounds grow with the logarithm of the
number of nodes. Ids stay in the cluster throughout; each round is a written
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links(a, b)``; component is the smallest node reachable.

    Self-links and nulls are ignored; a table without links gives no rows.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "hook")
        if mapping is None:
            mapping = low.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = low.select(F.col("a").alias("component"), "p")
            mapping = materialize(mapping.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "map")
        ends = edges.join(low.select("a", F.col("p").alias("pa")), "a").join(low.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = materialize(ends.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
