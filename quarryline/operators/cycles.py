"""Components of mutual reach, and the cycles within them.

Components are found by trimming and colouring. Nodes that nothing enters or
leaves are on no cycle and are trimmed. Every other node takes as its colour the
smallest node that reaches it, in delta rounds: only nodes whose colour fell send
it on. A colour's own node and all that reach it within the colour are one
component. Edges between colours are on no cycle; what is left within a colour is
coloured again. No table of pairs of nodes is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.joins import sized
from quarryline.session import materialize


def _trimmed(step: DataFrame, rounds: int = 3) -> DataFrame:
    """Without the edges of nodes that nothing enters or leaves, ``rounds`` times over."""
    for _ in range(rounds):
        ends = step.select(F.col("caller").alias("node"), F.lit(1).alias("leaves")).union(step.select("callee", F.lit(0)))
        kept = sized(materialize(ends.groupBy("node").agg(F.min("leaves").alias("a"), F.max("leaves").alias("z")).where("a < z").select("node"), "kept"))
        step = materialize(step.join(kept.withColumnRenamed("node", "callee"), "callee", "left_semi").join(kept.withColumnRenamed("node", "caller"), "caller", "left_semi").select("caller", "callee"), "trimmed")
    return step


def _coloured(step: DataFrame) -> DataFrame:
    """``node, colour``: the smallest node that reaches each, itself included."""
    nodes = step.select(F.col("caller").alias("node")).union(step.select("callee")).distinct()
    colours = front = materialize(nodes.withColumn("colour", F.col("node")), "colours")
    new, step = front.count(), sized(step)
    while new:
        sent = sized(front, new).join(step, F.col("node") == F.col("caller")).groupBy(F.col("callee").alias("node")).agg(F.min("colour").alias("offer"))
        both = materialize(colours.join(sent.hint("merge"), "node", "left").select("node", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("fell")), "colours")
        colours, front = both.select("node", "colour"), both.where("fell").select("node", "colour")
        new = front.count()
    return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes that a cycle of ``edges(caller, callee)`` passes; component is its smallest node. Self-edges and nulls do not count."""
    step = materialize(edges.where("caller <> callee").select("caller", "callee").distinct(), "steps")
    out: DataFrame | None = None
    while True:
        step = _trimmed(step)
        if out is not None and step.isEmpty():
            return out
        colours, step = sized(_coloured(step)), sized(step)
        same = step.join(colours.withColumnRenamed("node", "caller"), "caller").join(colours.select(F.col("node").alias("callee"), F.col("colour").alias("other")), "callee")
        same = materialize(same.where(F.col("colour") == F.col("other")).select("caller", "callee", "colour"), "coloured")
        same = sized(same)
        found = front = materialize(colours.where(F.col("node") == F.col("colour")), "roots")
        total = new = front.count()
        while new:
            back = sized(front, new).join(same.withColumnRenamed("callee", "node"), ["node", "colour"]).select(F.col("caller").alias("node"), "colour").distinct()
            front = materialize(back.join(sized(found, total), "node", "left_anti"), "back")
            new = front.count()
            total += new
            found = found.unionByName(front)
        found = materialize(found, "strong")
        wide = found.groupBy("colour").count().where("count > 1").select("colour")
        found = sized(found, total)
        strong = materialize(found.join(wide.hint("merge"), "colour", "left_semi").select("node", F.col("colour").alias("component")), "strong")
        out = strong if out is None else out.unionByName(strong)
        rest = sized(materialize(colours.join(found, "node", "left_anti").select("node"), "rest"))
        step = same.join(rest.withColumnRenamed("node", "caller"), "caller", "left_semi").join(rest.withColumnRenamed("node", "callee"), "callee", "left_semi").select("caller", "callee")


def cycle_lists(edges: DataFrame, longest: int = 6, most: int = 10) -> DataFrame:
    """``component, place, cycle, length``: each component's ``most`` shortest cycles of up to ``longest`` edges, ties in the order of their nodes.

    A cycle is the array of its nodes from the smallest on, so that each is
    listed once. Lengths are walked one after another, and a component that has
    its ``most`` walks no further.
    """
    edges = sized(materialize(edges.where("caller <> callee").select("caller", "callee").distinct(), "edges"))
    strong = sized(materialize(strong_components(edges), "strong"))
    own = strong.select(F.col("node").alias("caller"), "component")
    other = strong.select(F.col("node").alias("callee"), F.col("component").alias("c"))
    step = edges.join(own, "caller").join(other, "callee")
    step = sized(materialize(step.where(F.col("component") == F.col("c")).select("caller", "callee", "component"), "inner"))
    hop = step.select("caller", "callee")
    front = step.where("callee > caller").select("component", F.array("caller", "callee").alias("path"))
    order = Window.partitionBy("component").orderBy(F.size("path"), "path")
    found: DataFrame | None = None
    for length in range(2, longest + 1):
        tail = F.element_at("path", -1)
        ahead = materialize(front.join(hop, tail == F.col("caller")).where((F.col("callee") == F.col("path")[0]) | ((F.col("callee") > F.col("path")[0]) & ~F.array_contains("path", F.col("callee")))).drop("caller"), "walks")
        closed = ahead.where(F.col("callee") == F.col("path")[0]).select("component", "path")
        every = closed if found is None else found.unionByName(closed)
        found = materialize(every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place"), "cycles")
        if length == longest:
            break
        front = ahead.where(F.col("callee") != F.col("path")[0]).select("component", F.array_append("path", F.col("callee")).alias("path"))
        full = found.groupBy("component").count().where(F.col("count") >= most)
        front = sized(front.join(full.hint("merge"), "component", "left_anti"))
        if front.isEmpty():
            break
    return found.select("component", F.row_number().over(order).alias("place"), F.col("path").alias("cycle"), F.size("path").alias("length"))
