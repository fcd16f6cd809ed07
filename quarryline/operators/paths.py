"""The best paths from sets of sources to sets of sinks, by labels.

A label is a path to a node with the confidence of its weakest edge. Every hop
extends all labels by one join and keeps the ``width`` best of each source and
node, so that memory is bounded by sources x nodes x ``width`` and nothing is
enumerated. A label is only extended to nodes that still reach a sink in the hops
left; how far the nearest sink is has been found by one backward walk from all
sinks together.

What was dropped is not forgotten: the best that a dropped label of a source
could still have become is kept, one row a source, and a path is ``sure`` if it
beats that. A path as sure and as short as the best of a source and a sink is
always found, since a label dropped in favour of another can be replaced by it,
or by a shorter path through a node that both share; only among equals may the
first by its nodes be missed, and then no path is called sure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import materialize


def nearest_sink(step: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """``node, left``: the fewest hops over ``step(caller, callee)`` to any of ``sinks(node)``, up to ``depth``."""
    found = front = materialize(sinks.select("node").distinct().withColumn("left", F.lit(0)), "goals")
    for hop in range(1, depth + 1):
        ahead = front.join(step.select(F.col("callee").alias("node"), "caller"), "node").select(F.col("caller").alias("node")).distinct()
        front = materialize(ahead.join(found, "node", "left_anti").withColumn("left", F.lit(hop)), "goals")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def best_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, k: int = 20, depth: int = 10, minimum: float = 0.5, width: int | None = None) -> DataFrame:
    """``source, sink, place, path, hops, confidence, sure``: the ``k`` best simple paths of each source and sink of ``edges(caller, callee, confidence)``.

    Best by weakest edge, then fewest hops, then the nodes in order. Edges below
    ``minimum``, self-edges and nulls do not count; of parallel edges the surest
    does. ``sources`` and ``sinks`` have a column ``node``. A path may pass by
    other sources and sinks. ``width`` labels (``k`` unless given) stay at a node
    for each source and number of hops. ``sure``: no path left out is better.
    """
    width = width or k
    good = edges.where((F.col("confidence") >= minimum) & (F.col("caller") != F.col("callee")))
    step = materialize(good.groupBy("caller", "callee").agg(F.max("confidence").alias("confidence")), "steps")
    near = nearest_sink(step, sinks, depth)
    step = materialize(step.join(near.withColumnRenamed("node", "callee"), "callee").select("caller", "callee", "confidence", "left"), "ways")
    labels = sources.select(F.col("node").alias("source"), F.col("node"), F.array("node").alias("path"), F.lit(1.0).alias("confidence")).distinct()
    nodes = Window.partitionBy("source", "node").orderBy(F.desc("confidence"), "path")
    arrived: DataFrame | None = None
    dropped: DataFrame | None = None
    goal = sinks.select(F.col("node")).distinct()
    for hop in range(1, depth + 1):
        ahead = labels.join(step.withColumnRenamed("confidence", "edge"), F.col("node") == F.col("caller"))
        ahead = ahead.where((F.lit(hop) + F.col("left") <= depth) & ~F.array_contains("path", F.col("callee")))
        grown = ahead.select("source", F.col("callee").alias("node"), F.array_append("path", F.col("callee")).alias("path"), F.least("confidence", "edge").alias("confidence"), "left")
        ranked = materialize(grown.withColumn("rank", F.row_number().over(nodes)).where(F.col("rank") <= width + 1), "labels")
        labels = ranked.where(F.col("rank") <= width).drop("rank", "left")
        lost = ranked.where(F.col("rank") > width).select("source", F.struct("confidence", (-(F.lit(hop) + F.col("left"))).alias("hops")).alias("could"))
        here = labels.join(goal, "node", "left_semi").withColumn("hops", F.lit(hop))
        arrived = here if arrived is None else arrived.unionByName(here)
        dropped = lost if dropped is None else dropped.unionByName(lost)
        if ranked.isEmpty():
            break
    order = Window.partitionBy("source", "sink").orderBy(F.desc("confidence"), "hops", "path")
    best = arrived.withColumnRenamed("node", "sink").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    bound = dropped.groupBy("source").agg(F.max("could").alias("could"))
    sure = F.col("could").isNull() | (F.col("could") < F.struct("confidence", (-F.col("hops")).alias("hops")))
    return best.join(bound, "source", "left").select("source", "sink", "place", "path", "hops", "confidence", sure.alias("sure"))
