"""File trees as a Spark data source: ``spark.read.format("file_tree").option("root", folder)``.

The driver plans the reading from folder names alone. It walks down from the root
until there are folders enough for the tasks and never enters a skipped one; each
task walks the folders it was given in the same way. Filters on ``lang``, ``size``
and ``path`` are pushed into the walk, so that a file they refuse is not opened,
and a prefix of ``path`` keeps whole folders closed. The root is a folder that the
driver and all executors have mounted; for other stores there is ``files.scan``.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quarryline.sources import files

SCHEMA = "path string, lang string, size long, modified timestamp, content binary"
ARROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary())])
#: Files of an output batch, and bytes of their contents and paths.
BATCH_ROWS, BATCH_BYTES = 10_000, 4_000_000
_LANGUAGES = {ending: name for name, endings in files.EXTENSIONS.items() for ending in endings}
#: Folders planned for each task, so that uneven ones balance.
FOLDERS_A_TASK = 4


def enters(name: str) -> bool:
    """Whether a folder of this name is walked: none that ``files.skipped`` would leave out for it."""
    low = name.lower()
    if low in files.SKIPPED_FOLDERS or low.endswith(".egg-info") or low.startswith(tuple(files.TOOLKIT_PREFIXES)):
        return False
    return not low.startswith(".") or low in files.KEPT_HIDDEN


def language_of(path: str) -> str | None:
    found = re.search(r"\.([^./]+)$", path)
    return _LANGUAGES.get(found[1].lower()) if found else None


class Folders(ds.InputPartition):
    """Folders of one task: ``(relative path, whether all below it belongs to it)``."""

    def __init__(self, value: list[tuple[str, bool]]) -> None:
        super().__init__(value)


class TreeReader(ds.DataSourceReader):
    def __init__(self, root: str, tasks: int, with_content: bool) -> None:
        self.root, self.tasks, self.with_content = root, tasks, with_content
        self.langs: set[str] | None = None
        self.least, self.most = 0, None
        self.prefix = ""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f) -> bool:
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name == "lang" and isinstance(f, ds.EqualTo | ds.In):
            wanted = set(f.value if isinstance(f, ds.In) else [f.value])
            self.langs = wanted if self.langs is None else self.langs & wanted
        elif name == "lang" and isinstance(f, ds.IsNotNull):
            self.langs = set(_LANGUAGES.values()) if self.langs is None else self.langs
        elif name == "size" and isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual):
            self.least = max(self.least, f.value + isinstance(f, ds.GreaterThan))
        elif name == "size" and isinstance(f, ds.LessThan | ds.LessThanOrEqual):
            most = f.value - isinstance(f, ds.LessThan)
            self.most = most if self.most is None else min(self.most, most)
        elif name == "path" and isinstance(f, ds.StringStartsWith) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
            self.prefix = max(self.prefix, f.value, key=len)
        else:
            return name in ("path", "size") and isinstance(f, ds.IsNotNull)
        return True

    def _within(self, folder: str) -> bool:
        """Whether files with the wanted prefix can lie below a folder, given with its slash."""
        return folder.startswith(self.prefix) or self.prefix.startswith(folder)

    def _entries(self, folder: str) -> Iterator[os.DirEntry]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            yield from found

    def _list(self, folder: str) -> tuple[list[str], Iterator[os.DirEntry]]:
        """The folders that are entered, and the files, listed while they are read: a folder's files are never held together."""
        below = sorted(folder + e.name + "/" for e in self._entries(folder) if e.is_dir(follow_symlinks=False) and enters(e.name) and self._within(folder + e.name + "/"))
        return below, (e for e in self._entries(folder) if e.is_file(follow_symlinks=False))

    def partitions(self) -> list[Folders]:
        whole, shallow = [""], []
        while whole and len(whole) < self.tasks * FOLDERS_A_TASK:
            opened = [(f, self._list(f)[0]) for f in whole]
            if not any(below for _, below in opened):
                break
            shallow += [f for f, _ in opened]
            whole = [b for _, below in opened for b in below]
        units = [(f, True) for f in whole] + [(f, False) for f in shallow]
        parts = max(1, min(self.tasks, len(units)))
        return [Folders(units[i::parts]) for i in range(parts)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        todo = list(partition.value)
        while todo:
            folder, deep = todo.pop()
            below, entries = self._list(folder)
            if deep:
                todo += [(b, True) for b in below]
            for e in entries:
                path, stat = folder + e.name, e.stat(follow_symlinks=False)
                lang = language_of(e.name)
                if not path.startswith(self.prefix) or (self.langs is not None and lang not in self.langs) or stat.st_size < self.least or (self.most is not None and stat.st_size > self.most):
                    continue
                content = None
                if self.with_content:
                    with open(e.path, "rb") as f:
                        content = f.read()
                yield path, lang, stat.st_size, datetime.datetime.fromtimestamp(stat.st_mtime), content


class BatchReader(TreeReader):
    """Rows in Arrow batches of bounded size; Spark itself would gather 10,000 files, whatever their size. A larger file is a batch of its own."""

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, lang, size, modified, content in super().read(partition):
            cost = len(path) + len(content or b"")
            if rows and (held + cost > BATCH_BYTES or len(rows) == BATCH_ROWS):
                yield _batch(rows)
                rows, held = [], 0
            rows.append((path, lang, size, modified.astimezone(datetime.UTC), content))
            held += cost
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class TreeSource(ds.DataSource):
    """Options: ``root``; ``tasks`` (8); ``content`` (``false`` gives names and sizes only, and opens nothing)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        root = re.sub(r"^file:(//)?(?=/)", "", self.options["root"])
        if not root.startswith("/"):
            raise ValueError(f"file_tree reads mounted folders, not {root}")
        return BatchReader(root, int(self.options.get("tasks", 8)), self.options.get("content", "true").lower() != "false")


def tree(spark: SparkSession, root: str, tasks: int = 8, content: bool = True) -> DataFrame:
    """``path, lang, size, modified, content`` of the files below a mounted folder, but for skipped folders."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("root", root).option("tasks", tasks).option("content", str(content)).load()


def scan(spark: SparkSession, root: str, exclude: list[str] = (), ignore_rules: list[str] = (), only: list[str] = (), changed: DataFrame | None = None, errors: str = "ignore", tasks: int = 8) -> DataFrame:
    """As ``files.scan``: ``path, lang, content`` of the text files below a mounted folder."""
    rows = tree(spark, root, tasks)
    if only:
        rows = rows.where(F.col("lang").isin(list(only)))
    path = F.col("path")
    rows = rows.where(~files.skipped(path) & ~files.generated_name(path) & ~files.glob(path, list(exclude)) & ~files.ignored_by_file(path, list(ignore_rules)))
    if changed is not None:
        rows = rows.join(changed.select("path").distinct(), "path", "left_semi")
    return files.texts(rows, errors)
