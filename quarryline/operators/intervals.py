"""An index of intervals for points: which interval around a point is the smallest.

An interval is covered by dyadic bins, at most two of each size: bin ``b`` of
level ``n`` holds the numbers from ``b * 2^n`` on, ``2^n`` of them. A point lies in
one bin of each level, so an equality join on bins finds the intervals around it,
each once. Of a bin's intervals only the best can win, so a bin is one row and the
join's output is at most points x levels, however the intervals overlap.

A key of few intervals has no use for bins, which are more rows than its intervals:
its points meet all of them, ``FEW`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.joins import SMALL_ROWS, sized_join
from quarryline.session import materialize, tasks_by_rows

#: A key of more intervals has its bins looked up instead.
FEW = 32


def _halved(x: Column, times: Column) -> Column:
    return F.call_function("shiftright", x, times)


def cover(lo: Column, hi: Column, levels: int) -> Column:
    """Array of the bins ``(level, bin)`` that cover ``lo`` to ``hi``, both included; empty where ``hi`` is below ``lo``. Intervals of ``2^levels`` numbers or more need more levels."""

    def of(level: Column) -> Column:
        first, end = -_halved(-lo, level), _halved(hi + 1, level)  # rounded up, rounded down
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        left = F.when(odd(first) & (first < end), first)
        right = F.when(odd(end) & (F.when(odd(first), first + 1).otherwise(first) < end), end - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda b: F.struct(level.alias("level"), b.alias("bin")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def bins_of(at: Column, levels: int) -> Column:
    """Array of the bins ``(level, bin)`` that a number lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.struct(n.alias("level"), _halved(at, n).alias("bin")))


def levels_for(intervals: DataFrame, lo: str = "lo", hi: str = "hi") -> int:
    """How many levels the longest interval needs."""
    longest = intervals.agg(F.max(F.col(hi) - F.col(lo) + 1)).first()[0] or 1
    return int(longest).bit_length()


def smallest_enclosing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, point_id: str, *, carry: tuple[str, ...] = (), ties: tuple[str, ...] = ("lo", "hi")) -> DataFrame:
    """``point_id, lo, hi, span`` and ``carry`` of the smallest interval ``lo, hi`` of equal ``keys`` around each point; none, no row.

    Intervals of one span go by ``ties``. Nulls are in no interval and around no point.
    """
    intervals = intervals.select(*keys, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), *carry)
    intervals = intervals.where("lo is not null and hi is not null")
    points = points.where(F.col(at).isNotNull()).select(point_id, *keys, F.col(at).cast("long").alias("_at"))
    names = dict.fromkeys((*ties, "lo", "hi", *carry))
    best = F.struct((F.col("hi") - F.col("lo")).alias("span"), *names).alias("best")
    many = materialize(intervals.groupBy(*keys).count().where(F.col("count") > FEW), "many")
    large, held_rows = many.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    many = many.select(*keys)
    of_many = lambda df, how: df.join(F.broadcast(many) if large <= SMALL_ROWS else many.hint("merge"), keys, how) if large else df
    found = of_many(points, "left_anti").join(of_many(intervals, "left_anti").select(*keys, "lo", "hi", best).hint("merge"), keys).where("_at between lo and hi").select(point_id, "best")
    if large:
        held, asked = of_many(intervals, "left_semi"), of_many(points, "left_semi")
        with tasks_by_rows(held.sparkSession, max(held_rows, asked.count())) as tasks:  # a row becomes a few bins
            dealt = lambda df, *by: df.repartition(tasks, *by) if tasks > 1 else df
            levels = levels_for(held)
            binned = dealt(held, *keys, "lo", "hi", *carry).select(*keys, best, F.explode(cover(F.col("lo"), F.col("hi"), levels)).alias("b"))
            index = materialize(binned.groupBy(*keys, "b.level", "b.bin").agg(F.min("best").alias("best")), "interval-index")
            places = dealt(asked, point_id).select(point_id, *keys, F.explode(bins_of(F.col("_at"), levels)).alias("b")).select(point_id, *keys, "b.level", "b.bin")
            near = sized_join(places, index, [*keys, "level", "bin"]).select(point_id, "best")
            found = found.unionByName(materialize(near.groupBy(point_id).agg(F.min("best").alias("best")), "enclosed"))
    return found.groupBy(point_id).agg(F.min("best").alias("best")).select(point_id, "best.lo", "best.hi", "best.span", *[f"best.{c}" for c in carry])
