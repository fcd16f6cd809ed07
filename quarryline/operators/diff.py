"""Comparing states: baselines, snapshots, metric deltas, trends, cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beyond_baseline(hits: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """Hits whose key the baseline lacks."""
    return hits.join(baseline.select(*key).distinct(), key, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], order: str) -> DataFrame:
    """``key..., status`` new or resolved, with the last row of each key by ``order``."""
    last = lambda df: df.groupBy(*key).agg(F.max(order).alias(order))
    old, new = last(before), last(after)
    return new.join(old, key, "left_anti").withColumn("status", F.lit("new")).unionByName(old.join(new, key, "left_anti").withColumn("status", F.lit("resolved")))


def metric_deltas(before: DataFrame, after: DataFrame, name: str, value: str, places: int = 1) -> DataFrame:
    """Full outer comparison; a missing value is 0, changes below 0.001 are left out, the rest is rounded."""
    a, b = before.select(name, F.col(value).alias("before")), after.select(name, F.col(value).alias("after"))
    both = a.join(b, name, "full").fillna(0.0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before")).where("abs(delta) >= 0.001").select(name, F.round("before", places).alias("before"), F.round("after", places).alias("after"), F.round("delta", places).alias("delta"))


def trend_class(score: Column, critical: Column, blocking: Column) -> Column:
    """Class of changes from first to last: regressing, improving or stable."""
    return F.when((score <= -5) | (critical > 0) | (blocking > 0), "regressing").when((score >= 5) & (critical <= 0) & (blocking <= 0), "improving").otherwise("stable")


def first_last(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """For each group the change of each column from the first to the last row by ``order``."""
    change = [(F.max_by(c, order) - F.min_by(c, order)).alias(f"d_{c}") for c in columns]
    return df.groupBy(*group).agg(*change)


def fresh(df: DataFrame, key: list[str], ts: str, days: int) -> DataFrame:
    """The newest row of each key that is at most ``days`` older than the newest of all."""
    now = df.agg(F.max(ts).alias("_now"))  # one row
    kept = df.join(F.broadcast(now)).where(F.col(ts) >= F.col("_now") - F.expr(f"interval {int(days)} days")).drop("_now")
    return kept.groupBy(*key).agg(F.max(ts).alias(ts))

