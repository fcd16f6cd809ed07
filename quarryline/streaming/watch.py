"""Watching a folder: new files as a stream; and, poll by poll, files that are new or have changed.

A file stream reads each path once, so a file that is written again is not seen.
``changes`` compares listings instead, which cost a listing a poll.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def watch(spark: SparkSession, folder: str, schema: StructType, state: str, each: Callable[[DataFrame, int], None], seconds: int | None = None, pattern: str = "*.parquet"):
    """Starts a file stream over ``folder``; ``each(batch, id)`` handles the files that are new.

    ``state`` is the folder of the stream's checkpoint: a restart goes on where
    it stopped. Without ``seconds`` the stream takes what is there and ends.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", state)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, modified, length`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, state`` of the files of a listing that are added or changed since another; what is gone is not reported."""
    both = now.join(before.select("path", F.col("modified").alias("was"), F.col("length").alias("size")), "path", "left")
    state = F.when(F.col("was").isNull(), "added").when((F.col("was") != F.col("modified")) | (F.col("size") != F.col("length")), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def poll(spark: SparkSession, folder: str, each: Callable[[DataFrame], None], rounds: int, wait: Callable[[], None], pattern: str = "*") -> None:
    """Hands the added and changed files of each round to ``each``; ``wait`` pauses between rounds. The first listing is only remembered."""
    from quarryline.session import materialize, release, scratch_scope

    with scratch_scope() as made:
        last = materialize(file_listing(spark, folder, pattern), "listing")
    for _ in range(rounds):
        wait()
        with scratch_scope() as fresh:
            now = materialize(file_listing(spark, folder, pattern), "listing")
        found = changes(last, now)
        if not found.isEmpty():
            each(found)
        release(spark, made)
        last, made = now, fresh
    release(spark, made)
