"""What the text operators share: row access, word hashing, bounded caches."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 256
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns of any name play no part."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` with ``docs``'s own columns, which may have any name: numbered on the way in, named again on the way out."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def share(spark: SparkSession, value):
    """A function that gives ``value`` in a task, from a broadcast.

    Broadcasts pickle classes by name, and executors may not have this package;
    so the value travels as bytes that carry its classes.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        return pickle.loads(held.value)  # noqa: S301  our own bytes

    return get


def tidy() -> None:
    """Give back to the system what earlier tasks of a reused worker have freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that only so many texts are Python objects at a time."""
    tidy()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, in order; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count]
    for j in range(1, n):
        out = mix(out) + hashes[j : j + count]
    return mix(out + np.uint64(n))


def crc32_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; fixes which rows are held out."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def crc32_mod_py(value: int, modulus: int) -> int:
    return zlib.crc32(str(value).encode()) % modulus


def process_cache(name: str, make):
    """One object a Python process, shared by the tasks that a reused worker runs one after another."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault("quarryline_process_cache", ModuleType("quarryline_process_cache")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
