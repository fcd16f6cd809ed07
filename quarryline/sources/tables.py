"""Named Parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder, on any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
