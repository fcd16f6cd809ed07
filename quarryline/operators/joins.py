"""Joins whose smaller side is counted first, and whose hot keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialize

#: A written table of at most so many rows of a few columns may be broadcast.
BROADCAST_ROWS = 500_000
SALTS = 16
#: A side of more rows is not broadcast. Spark would: it goes by the bytes of compressed files, which may hold a hundred times as much in the driver's memory.
SMALL_ROWS = 100_000
#: Rows of a key that ``paired_join`` deals to a part, on either side, and pairs of rows that a task of its makes, as far as so many tasks go.
ROWS_A_PART, PAIRS_A_TASK, MOST_TASKS = 2_000, 4_000_000, 2_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table, or a written one, that its joins do not broadcast where it has more than ``SMALL_ROWS`` rows; ``rows`` saves the count."""
    return df.hint("merge") if (df.count() if rows is None else rows) > SMALL_ROWS else df


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join to a written table: broadcast after a count, else by sorting, where Spark itself splits the left side's hot keys; nothing is copied."""
    return left.join(F.broadcast(right) if right.count() <= SMALL_ROWS else right.hint("merge"), keys, how)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "left") -> DataFrame:
    """Join to a written table with one row a key: broadcast after a count, else in ``SALTS`` copies, the left side's rows dealt among them by the columns ``by``."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], how).drop("_salt")


def paired_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two written tables of distinct rows on a key that may have many rows on both sides.

    Each side's rows of a key are dealt into parts, and each part of one side
    meets each of the other, so that no key is one task's work. Tasks go by the
    pairs to be made, not by bytes read.
    """
    rows = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    keys = materialize(rows(left, "_l").join(rows(right, "_r"), key), "keys")
    pairs = keys.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    if pairs <= PAIRS_A_TASK:
        return sized_join(left, right, [key])
    tasks = min(max(int(pairs / PAIRS_A_TASK) + 1, left.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    parts = keys.select(key, *[F.ceil(F.col(n) / ROWS_A_PART).alias(n) for n in ("_l", "_r")])

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine, each = F.pmod(F.xxhash64(*df.columns), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return sized_join(df, parts, [key]).select(*df.columns, mine.alias(f"{own}_part"), each.alias(f"{other}_part")).repartition(tasks, key, "_l_part", "_r_part")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l").hint("merge"), [key, "_l_part", "_r_part"]).drop("_l_part", "_r_part")
