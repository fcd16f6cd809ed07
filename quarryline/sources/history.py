"""Change histories and diffs as tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_log(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """``commit, author, at, path, added, deleted`` of a log in which each commit is
    ``<marker>hash|email|epoch`` and then lines of added, deleted and path, tab-separated.

    The marker separates the records, so that a commit is one row and no window
    carries its header forward. Binary files count 0 lines; an empty author is
    ``unknown``; a commit whose header has not three parts is left out.
    """
    record = spark.read.option("lineSep", marker).text(path).select(F.split("value", "\r?\n", -1).alias("rows"))
    head = F.split(F.col("rows")[0], "\\|", -1)
    commits = record.where(F.size(head) == 3).select(
        head[0].alias("commit"),
        F.when(head[1] == "", "unknown").otherwise(head[1]).alias("author"),
        F.timestamp_seconds(F.expr("try_cast(split(rows[0], '[|]')[2] as bigint)")).alias("at"),
        F.explode(F.slice("rows", 2, 2**31 - 1)).alias("row"),
    )
    part = F.split("row", "\t", 3)
    count = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(part[i], "^[0-9]+$", 0), F.lit("9999999999")).cast("long"), F.lit(0))
    return commits.where(F.size(part) == 3).select("commit", "author", "at", F.replace(part[2], F.lit("\\"), F.lit("/")).alias("path"), count(0).alias("added"), count(1).alias("deleted"))


def file_history(log: DataFrame) -> DataFrame:
    """``path, changed, commits, authors, top_author, top_share``; a file counts once a commit, however many rows it has there."""
    once = log.groupBy("path", "author", "commit").agg(F.sum(F.col("added") + F.col("deleted")).alias("n"))
    by_author = once.groupBy("path", "author").agg(F.count("*").alias("commits"), F.sum("n").alias("n"))
    top = F.max("commits")
    # ties: the smaller author
    first = F.min(F.struct((-F.col("commits")).alias("c"), "author"))["author"]
    return by_author.groupBy("path").agg(F.sum("n").alias("changed"), F.sum("commits").alias("commits"), F.count("*").alias("authors"), first.alias("top_author"), F.round(top / F.sum("commits"), 3).alias("top_share"))


def changed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no`` of the lines that a unified diff without context adds or changes; a record is one file."""
    files = spark.read.option("lineSep", "\n+++ b/").text(path).where("value not like 'diff --git %'")
    hunk = r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    all_of = lambda i: F.regexp_extract_all("value", F.lit(hunk), F.lit(i))
    hunks = files.select(F.trim(F.split("value", "\n")[0]).alias("path"), F.explode(F.arrays_zip(all_of(1).alias("start"), all_of(2).alias("n"))).alias("h"))
    spans = hunks.select("path", F.col("h.start").cast("int").alias("start"), F.when(F.col("h.n") == "", 1).otherwise(F.expr("try_cast(h.n as int)")).alias("n")).where("n > 0")
    return spans.select("path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line_no")).distinct()


def changed_names(spark: SparkSession, path: str) -> DataFrame:
    """``path, status`` of a listing of names with their status: added, copied, modified and renamed files, the last two under their new name."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    status = F.substring(F.col("p")[0], 1, 1)
    return rows.select(F.replace(F.element_at("p", -1), F.lit("\\"), F.lit("/")).alias("path"), status.alias("status")).where(F.col("status").isin("A", "C", "M", "R")).distinct()


def diff_base(wanted: str | None, first_since: Callable[[str], str | None], verify: Callable[[str], bool]) -> str:
    """The commit to compare with: the last but one by default; before a day the parent of its first commit; else a name that must exist."""
    if not wanted:
        return "HEAD~1"
    if re.match(r"\d{4}-\d{2}-\d{2}", wanted):
        first = first_since(wanted)
        return f"{first}~1" if first else "HEAD"
    if not verify(wanted):
        raise ValueError(f"no such commit: {wanted}")
    return wanted


def incremental(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings (``path, line_no``) on lines that have changed (``path, line_no``), and those of changed files without a line."""
    lines = findings.join(changed.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi").select(findings.columns)
    whole = findings.where("line_no is null").join(changed.select("path").distinct(), "path", "left_semi").select(findings.columns)
    return lines.unionByName(whole)
