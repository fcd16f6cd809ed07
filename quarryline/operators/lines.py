"""Line facts of a text table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import split_lines


def explode_lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key..., line_no, line``, numbered from 1. A narrow operation: no shuffle."""
    return df.select(*key, F.posexplode(split_lines(F.col(text))).alias("at", "line")).select(*key, (F.col("at") + 1).alias("line_no"), "line")


def line_metrics(df: DataFrame, group: list[str], text: str = "text") -> DataFrame:
    """Counts by ``group``: all, blank, comment and code lines.

    A blank line has nothing but white space; a comment starts with ``#`` or
    ``//``; code is neither blank nor a ``#`` line, so a ``//`` line is both a
    comment and code.
    """
    lines = df.select(*group, F.explode(split_lines(F.col(text))).alias("line"))
    bare = F.regexp_replace("line", r"^[ \t\r]+", "")
    blank, hashed, slashed = bare == "", bare.startswith("#"), bare.startswith("//")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return lines.groupBy(*group).agg(
        F.count("*").alias("loc"),
        count(blank).alias("blank_lines"),
        count(hashed | slashed).alias("comment_lines"),
        count(~blank & ~hashed).alias("sloc"),
    )
