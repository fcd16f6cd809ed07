"""Walks over an edge table ``caller, callee, confidence``.

Each hop is one join and one distinct, so a walk of depth d plans d joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.cycles import strong_components
from quarryline.operators.intervals import smallest_enclosing
from quarryline.session import materialize


def neighbours(edges: DataFrame, minimum: float, top: int = 50) -> DataFrame:
    """Each caller's edges of at least ``minimum``, most confident first; ``rank`` up to ``top``."""
    rank = F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("confidence"), "callee"))
    return edges.where(F.col("confidence") >= minimum).withColumn("rank", rank).where(F.col("rank") <= top)


def _steps(edges: DataFrame) -> DataFrame:
    """The distinct edges between different nodes, written once for all hops of a walk."""
    return materialize(edges.where("caller is not null and callee is not null and caller <> callee").select("caller", "callee").distinct(), "steps")


def reach(edges: DataFrame, depth: int, starts: DataFrame | None = None, forward: bool = True) -> DataFrame:
    """``origin, node, hops``: every node within ``depth`` hops of each start (``node``), by its fewest hops; the origin itself is left out.

    Backwards it follows edges from callee to caller. Without ``starts`` every
    node is one, and the result may be all pairs: only for small graphs.
    """
    a, b = ("caller", "callee") if forward else ("callee", "caller")
    step = _steps(edges).select(F.col(a).alias("node"), F.col(b).alias("next"))
    first = step if starts is None else step.join(starts.select("node").distinct(), "node", "left_semi")
    found = front = first.select(F.col("node").alias("origin"), F.col("next").alias("node"), F.lit(1).alias("hops"))
    for hop in range(2, depth + 1):
        ahead = front.join(step, "node").select("origin", F.col("next").alias("node")).where("origin <> node").distinct()
        front = materialize(ahead.join(found, ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        found = found.unionByName(front)
    return found


def hop_edges(edges: DataFrame, starts: DataFrame, depth: int, minimum: float = 0.5, forward: bool = True) -> DataFrame:
    """The edges of at least ``minimum`` that leave a node less than ``depth`` hops from its start, cross and back edges included: the edges' columns, ``origin, hop``."""
    good = materialize(edges.where(F.col("confidence") >= minimum), "good")
    a = "caller" if forward else "callee"
    near = reach(good, depth - 1, starts, forward) if depth > 1 else None
    own = starts.select(F.col("node").alias("origin"), "node").distinct().withColumn("hops", F.lit(0))
    visited = own if near is None else own.unionByName(near)
    return visited.join(good, visited.node == good[a]).select("origin", (F.col("hops") + 1).alias("hop"), *good.columns)


def entry_points(edges: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Callers that no edge of at least ``minimum`` leads to."""
    into = edges.where(F.col("confidence") >= minimum).select(F.col("callee").alias("node")).distinct()
    return edges.select(F.col("caller").alias("node")).distinct().join(into, "node", "left_anti")


def simple_paths(edges: DataFrame, source, depth: int, sink=None, most: int | None = None) -> DataFrame:
    """``path, hops, confidence`` of the paths without a repeated node from ``source``, to ``sink`` if one is given; confidence is the weakest edge's.

    ``most`` keeps the first so many: most confident, fewest hops, path. Paths
    grow with the number of ways, so ``depth`` should be small. With a sink only
    nodes that still reach it in the hops left are walked.
    """
    step = materialize(edges.select("caller", "callee", "confidence").where("caller <> callee"), "steps")
    if sink is not None:
        goal = step.select(F.col("callee").alias("node")).where(F.col("node") == sink).distinct()
        ways = reach(step, depth - 1, goal, forward=False).select("node").unionByName(goal).distinct() if depth > 1 else goal
        step = step.join(ways.withColumnRenamed("node", "callee"), "callee", "left_semi").select("caller", "callee", "confidence")
        step = materialize(step, "ways")
    front = step.where(F.col("caller") == source).select(F.array("caller", "callee").alias("path"), F.col("confidence").alias("c"))
    out = front
    for _ in range(depth - 1):
        tail = F.element_at("path", -1)
        onward = front if sink is None else front.where(tail != sink)
        front = materialize(onward.join(step, tail == step.caller).where(~F.array_contains("path", F.col("callee"))).select(F.array_append("path", F.col("callee")).alias("path"), F.least("c", "confidence").alias("c")), "paths")
        out = out.unionByName(front)
    if sink is not None:
        out = out.where(F.element_at("path", -1) == sink)
    named = out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).alias("hops"), F.col("c").alias("confidence"))
    return named if most is None else named.orderBy(F.desc("confidence"), "hops", "path").limit(most)


def in_cycle(edges: DataFrame, depth: int) -> DataFrame:
    """Nodes that lie on a cycle of at most ``depth`` edges, with the length of the shortest; self-edges do not count.

    Only nodes of a component of mutual reach are walked from, within it. For
    membership alone, of any length, ``cycles.strong_components`` needs no pairs.
    """
    strong = materialize(strong_components(edges), "strong")
    step = _steps(edges).join(strong.select(F.col("node").alias("caller"), "component"), "caller").join(strong.select(F.col("node").alias("callee"), F.col("component").alias("other")), "callee")
    step = materialize(step.where(F.col("component") == F.col("other")).select("caller", "callee"), "inner")
    near = reach(step, depth - 1)
    closing = near.join(step, (near.node == step.caller) & (near.origin == step.callee))
    return closing.groupBy(F.col("origin").alias("node")).agg((F.min("hops") + 1).alias("cycle_length"))


def propagate_flag(edges: DataFrame, flagged: DataFrame, passes: int = 6) -> DataFrame:
    """Nodes flagged, or with a callee that is, after at most ``passes`` rounds: ``node, round``."""
    step = materialize(edges.select("caller", F.col("callee").alias("node")).distinct(), "steps")
    found = front = flagged.select("node").distinct().withColumn("round", F.lit(0))
    for n in range(1, passes + 1):
        callers = front.join(step, "node").select(F.col("caller").alias("node")).distinct()
        front = materialize(callers.join(found, "node", "left_anti").withColumn("round", F.lit(n)), "flag")
        found = found.unionByName(front)
    return found


def impact(edges: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Edges into each node within two hops, and the score: 10 each up to 3, then 5 each up to 10, then 3 each, at most 100."""
    good = edges.where(F.col("confidence") >= minimum)
    into = good.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n"))
    first = good.select("callee", "caller").distinct().where("callee <> caller")
    second = first.join(into, first.caller == into.node).groupBy("callee").agg(F.sum("n").alias("m"))
    total = into.join(second, into.node == second.callee, "left").select("node", (F.col("n") + F.coalesce("m", F.lit(0))).alias("edges"))
    n = F.col("edges")
    return total.withColumn("impact", F.when(n <= 3, 10 * n).when(n <= 10, 30 + 5 * (n - 3)).otherwise(F.least(F.lit(100), 65 + 3 * (n - 10))).cast("long"))


def enclosing_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, point_id: str) -> DataFrame:
    """For each point the smallest interval ``[lo, hi]`` of its key around it, the earlier on ties, by an index of intervals."""
    return smallest_enclosing(points, intervals, [key], at, point_id)


def processes(edges: DataFrame, entries: DataFrame, depth: int = 8, smallest: int = 3) -> DataFrame:
    """``origin, functions, max_depth`` of what each entry (``node``) reaches within ``depth`` hops, itself included; small ones are left out."""
    starts = entries.select("node").distinct()
    step = _steps(edges)
    found = front = starts.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth"))
    for hop in range(1, depth + 1):
        ahead = front.join(step, front.node == step.caller).select("origin", F.col("callee").alias("node")).distinct()
        front = materialize(ahead.join(found, ["origin", "node"], "left_anti").withColumn("depth", F.lit(hop)), "process")
        found = found.unionByName(front)
    return found.groupBy("origin").agg(F.count("*").alias("functions"), F.max("depth").alias("max_depth")).where(F.col("functions") >= smallest)
