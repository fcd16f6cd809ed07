"""Session defaults and the shared scratch folder.

Scratch tables cut lineage: they are Parquet, written to the folder that the
session names in ``spark.checkpoint.dir``, which every executor can reach, so a
lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts. Spark deals by bytes instead, and numbers compress well: a few MB may become hundreds in a task's memory.
ROWS_A_TASK = 100_000
_made: dict[str, list[str]] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def build_session(cores: str = "*", partitions: int = 8, app: str = "quarryline") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the scratch folder, deleted by ``release``, or when the application's Python ends."""
    path = f"{scratch_root(spark)}/quarryline/{tag}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_release_rest, spark, app)
    _made[app].append(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Lists the scratch paths made inside, by this thread; an outer scope lists them too."""
    outer, made = _scope.get(), []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
        if outer is not None:
            outer.extend(made)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tasks_by_rows(spark: SparkSession, rows: int) -> Iterator[int]:
    """Gives the number of tasks for so many rows; what is written inside is shuffled to as many, where the cores are fewer, and not merged again."""
    tasks = -(-rows // ROWS_A_TASK)
    inside = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"} if tasks > spark.sparkContext.defaultParallelism else {}
    before = {key: spark.conf.get(key, None) for key in inside}
    try:
        for key, value in inside.items():
            spark.conf.set(key, value)
        yield tasks
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables. Only for those whose readers' results have been written."""
    made = _made.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in made:
            made.remove(path)
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _release_rest(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext.applicationId == app:
            release(spark, list(_made.get(app, [])))
    except Exception:  # noqa: BLE001  the application has ended before its Python
        return
