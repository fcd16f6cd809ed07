import os
import threading

import pytest
from pyspark.sql import functions as F

from quarryline.sinks.bucket_cache import BucketCache

SCHEMA = "key string, made int, v int"


def rows(spark, some):
    return spark.createDataFrame(some, SCHEMA)


@pytest.fixture
def cache(spark, tmp_path):
    return BucketCache(spark, f"file://{tmp_path}/cache", SCHEMA, "key", "made", buckets=16)


def data_files(cache):
    root = cache.root.removeprefix("file://")
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(f"{root}/data") for n in names if n.endswith(".parquet")}


def test_newest_entry_counts(spark, cache):
    assert cache.read().count() == 0 and cache.update(rows(spark, [])) == []
    cache.update(rows(spark, [(f"k{i}", 1, i) for i in range(200)] + [(None, 1, 1)]))
    cache.update(rows(spark, [("k3", 2, -3), ("k4", 0, -4), ("new", 5, 5)]))
    got = {r.key: r.v for r in cache.read().collect()}
    assert got == {f"k{i}": i for i in range(200)} | {"k3": -3, "new": 5}
    wanted = spark.createDataFrame([("k3",), ("absent",), ("new",)], "key string")
    assert sorted(map(tuple, cache.read(wanted).collect())) == [("k3", 2, -3), ("new", 5, 5)]


def test_an_update_writes_touched_buckets_only(spark, cache):
    cache.update(rows(spark, [(f"k{i}", 1, i) for i in range(500)]))
    before = data_files(cache)
    touched = cache.update(rows(spark, [("k7", 2, 0), ("k8", 2, 0)]))
    after = data_files(cache)
    assert len(touched) <= 2 and {f: t for f, t in after.items() if f in before} == before and len(after) - len(before) == len(touched)
    assert cache.read().count() == 500


def test_readers_see_whole_updates(spark, cache):
    cache.update(rows(spark, [(f"k{i}", 1, 1) for i in range(100)]))
    held = cache.read()  # a reader that has begun
    cache.update(rows(spark, [(f"k{i}", 2, 2) for i in range(100)]))
    assert {r.v for r in held.collect()} == {1} and {r.v for r in cache.read().collect()} == {2}
    assert cache.vacuum(keep=1) == len(set(cache.manifest()[1])) and {r.v for r in cache.read().collect()} == {2}


def test_two_writers_lose_nothing(spark, cache, monkeypatch):
    cache.update(rows(spark, [("seed", 1, 1)]))
    own, raced = cache._publish, []

    def publish(number, live):
        if not raced:  # another writer is faster once
            raced.append(1)
            other = BucketCache(spark, cache.root, SCHEMA, "key", "made")
            other.update(rows(spark, [("theirs", 1, 2)]))
        return own(number, live)

    monkeypatch.setattr(cache, "_publish", publish)
    cache.update(rows(spark, [("ours", 1, 3)]))
    assert {r.key for r in cache.read().collect()} == {"seed", "theirs", "ours"}
    many = [threading.Thread(target=lambda i=i: BucketCache(spark, cache.root, SCHEMA, "key", "made").update(rows(spark, [(f"t{i}", 1, i)]))) for i in range(3)]
    for t in many:
        t.start()
    for t in many:
        t.join()
    assert cache.read().where(F.col("key").startswith("t")).count() == 4
