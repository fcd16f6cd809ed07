"""Ordered scans that no key confines to one task.

Rows are dealt in ranges of their key and order, so that one log, one file or one
limiter is many ranges. Each range is folded apart; its summary is one row; the
summaries of a key, few of them, are composed in order; and what has come before a
range is carried back to its rows by a join. The folds are those whose summaries
compose: sums, minima and maxima, and the last value seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.joins import spread_join
from quarryline.session import materialize

#: Rows of a range, about.
RANGE = 200_000


def ranged(rows: DataFrame, keys: list[str], order: list[str], size: int = RANGE) -> DataFrame:
    """The rows, written, with ``_range``: ascending in keys and order. Rows equal in both are in one range, and should be told apart by ``order``."""
    parts = max(1, -(-rows.count() // size))
    return materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _inside(keys: list[str], order: list[str]) -> tuple:
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    return within, within.rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: list[str]):
    """The ranges of a key before this one."""
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, carry: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return spread_join(rows, materialize(carry, "carry"), [*keys, "_range"], order).drop("_range")


def clamped_sum(rows: DataFrame, keys: list[str], order: list[str], delta: Column, name: str, size: int = RANGE) -> DataFrame:
    """The rows with ``name``: a running sum of ``delta`` (whole numbers) that never falls below 0, as of open brackets.

    It is the plain running sum less its least value so far, if that is negative.
    """
    within, upto = _inside(keys, order)
    numbered = ranged(rows.withColumn("_d", F.coalesce(delta, F.lit(0)).cast("long")), keys, order, size)
    local = numbered.withColumn("_s", F.sum("_d").over(upto))
    local = local.withColumn("_low", F.min("_s").over(upto))
    each = local.groupBy(*keys, "_range").agg(F.sum("_d").alias("s"), F.min("_s").alias("low"))
    start = F.coalesce(F.sum("s").over(_before(keys)), F.lit(0))
    carry = each.withColumn("_start", start)
    carry = carry.withColumn("_least", F.coalesce(F.min(F.col("_start") + F.col("low")).over(_before(keys)), F.lit(0))).select(*keys, "_range", "_start", "_least")
    out = _carried(local, carry, keys, order)
    value = F.col("_start") + F.col("_s") - F.least(F.lit(0), F.col("_least"), F.col("_start") + F.col("_low"))
    return out.withColumn(name, value).drop("_d", "_s", "_low", "_start", "_least")


def last_seen(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, size: int = RANGE) -> DataFrame:
    """The rows with ``name``: the last ``value`` that is not null, of this row or before it in its key."""
    _, upto = _inside(keys, order)
    local = ranged(rows.withColumn("_v", value), keys, order, size).withColumn("_last", F.last("_v", ignorenulls=True).over(upto))
    each = local.groupBy(*keys, "_range").agg(F.max_by("_last", F.struct(*order)).alias("end"))
    carry = each.select(*keys, "_range", F.last("end", ignorenulls=True).over(_before(keys)).alias("_came"))
    return _carried(local, carry, keys, order).withColumn(name, F.coalesce("_last", "_came")).drop("_v", "_last", "_came")


def paced(rows: DataFrame, keys: list[str], order: list[str], at: str, per_second: float, name: str = "start", size: int = RANGE) -> DataFrame:
    """The rows with ``name``, in seconds: the earliest start of each that is not before ``at``, nor sooner than ``1 / per_second`` after the one before.

    With a(j) the arrivals in order, the i-th starts at the largest of
    a(j) + (i - j) / rate over j <= i: a running maximum of a(j) - j / rate.
    """
    within, upto = _inside(keys, order)
    local = ranged(rows, keys, order, size).withColumn("_i", F.row_number().over(within))
    local = local.withColumn("_slack", F.max(F.col(at) - F.col("_i") / per_second).over(upto))
    each = local.groupBy(*keys, "_range").agg(F.count("*").alias("n"), F.max("_slack").alias("slack"))
    carry = each.withColumn("_off", F.coalesce(F.sum("n").over(_before(keys)), F.lit(0)))
    carry = carry.withColumn("_prior", F.max(F.col("slack") - F.col("_off") / per_second).over(_before(keys))).select(*keys, "_range", "_off", "_prior")
    out = _carried(local, carry, keys, order)
    most = F.greatest("_prior", F.col("_slack") - F.col("_off") / per_second)
    return out.withColumn(name, F.round(most + (F.col("_off") + F.col("_i")) / per_second, 6)).drop("_i", "_slack", "_off", "_prior")
