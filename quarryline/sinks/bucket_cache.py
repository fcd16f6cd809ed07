"""A cache of keyed rows in buckets, of which an update writes only those that it touches.

Entries are hashed to buckets. An update merges its rows with the present entries
of their buckets and writes these buckets anew, beside the old ones, in one job. A
manifest, one small file, names the folder that is live for each bucket; it is the
last thing written, under the next number, and only if nobody else has taken that
number: then the update is merged again on top. Readers take the newest manifest
and the folders it names, which no update changes, so they see all of an update or
nothing of it. ``vacuum`` deletes folders that no recent manifest names.

Two writers are told apart by the store's rename, which must refuse a name that is
taken, as HDFS does; a local disk, as in tests, leaves a moment between.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "_bucket"


class BucketCache:
    """Rows of ``schema`` with a ``key``; of equal keys the one with the largest ``made`` counts. ``buckets`` is fixed with the first update."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: str, made: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.made, self.buckets = spark, root.rstrip("/"), key, made, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def _names(self, folder: str) -> list[str]:
        store, at = self._at(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0] != ".")

    def manifest(self, number: int | None = None) -> tuple[int, dict[int, str]]:
        """The number of a manifest, the newest unless given, and the live folder of each bucket; 0 and none before the first."""
        number = number or (self._numbers() or [0])[-1]
        if not number:
            return 0, {}
        store, at = self._at(f"{self.root}/manifests/{number:012d}.json")
        stream = store.open(at)
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        self.buckets = held["buckets"]
        return number, {int(b): folder for b, folder in held["live"].items()}

    def _publish(self, number: int, live: dict[int, str]) -> bool:
        """Writes a manifest aside and moves it to its number; false if the number is taken."""
        store, at = self._at(f"{self.root}/manifests/{number:012d}.json")
        _, aside = self._at(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = store.create(aside, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "live": live}).encode()))
        out.close()
        if not store.exists(at) and store.rename(aside, at):  # a rename onto a file fails
            return True
        store.delete(aside, False)
        return False

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _load(self, live: dict[int, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(f"{folder}/{_BUCKET}={b}" for b, folder in live.items()))

    def read(self, keys: DataFrame | None = None, number: int | None = None) -> DataFrame:
        """All entries, or those of ``keys`` (a column of the key's name), of whose buckets only the folders are read."""
        _, live = self.manifest(number)
        if keys is None:
            return self._load(live)
        wanted = {r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()}  # at most as many as buckets
        return self._load({b: f for b, f in live.items() if b in wanted}).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def update(self, rows: DataFrame) -> list[int]:
        """Adds entries; gives the numbers of the buckets written. Rows with a null key do not count."""
        rows = rows.where(F.col(self.key).isNotNull()).select(self.schema.names)
        rest = [c for c in self.schema.names if c != self.key]
        while True:
            number, live = self.manifest()
            touched = sorted(r[0] for r in rows.select(self.bucket(F.col(self.key))).distinct().collect())
            if not touched:
                return []
            held = self._load({b: live[b] for b in touched if b in live})
            newest = held.unionByName(rows).groupBy(self.key).agg(F.max_by(F.struct(*rest), self.made).alias("_e")).select(self.key, "_e.*").select(self.schema.names)
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            # one file a touched bucket
            newest.withColumn(_BUCKET, self.bucket(F.col(self.key))).repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
            if self._publish(number + 1, live | dict.fromkeys(touched, folder)):
                return touched

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest ``keep``, and the buckets that these do not name; gives the number of folders deleted. Not while an update runs."""
        numbers = self._numbers()
        kept = [self.manifest(n)[1] for n in numbers[-keep:]]
        named = {f"{folder.rsplit('/', 1)[-1]}/{_BUCKET}={b}" for live in kept for b, folder in live.items()}
        gone = 0
        for n in numbers[:-keep]:
            store, at = self._at(f"{self.root}/manifests/{n:012d}.json")
            store.delete(at, False)
        for folder in self._names("data"):
            for part in (p for p in self._names(f"data/{folder}") if p.startswith(_BUCKET)):
                if f"{folder}/{part}" not in named:
                    store, at = self._at(f"{self.root}/data/{folder}/{part}")
                    store.delete(at, True)
                    gone += 1
        return gone
