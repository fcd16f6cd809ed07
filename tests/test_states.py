from pyspark.sql import functions as F

from quarryline.streaming import states

SCHEMA = "path string, digest string, at timestamp"


def batch(spark, folder, n, rows):
    spark.createDataFrame(rows, "path string, digest string, s int").select("path", "digest", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{folder}/b{n}")


def turn(spark, tmp_path):
    sights = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    states.run(states.file_states(sights, expire_seconds=100), f"{tmp_path}/out", f"{tmp_path}/state")
    rows = spark.read.parquet(f"{tmp_path}/out").select("path", "state", "digest", F.unix_timestamp("at").alias("s")).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[3], r[0], r[1]))


def test_added_changed_expired_over_restarts(spark, tmp_path):
    batch(spark, f"{tmp_path}/in", 1, [("a", "1", 10), ("b", "1", 11), ("a", "1", 12), ("a", "2", 13), (None, "9", 14)])
    first = [("a", "added", "1", 10), ("b", "added", "1", 11), ("a", "changed", "2", 13)]
    assert turn(spark, tmp_path) == first
    batch(spark, f"{tmp_path}/in", 2, [("a", "2", 50), ("a", "3", 60)])  # goes on from the checkpoint
    second = first + [("a", "changed", "3", 60)]
    assert turn(spark, tmp_path) == second
    batch(spark, f"{tmp_path}/in", 3, [("c", "1", 140)])  # b was last seen at 11, a at 60
    got = turn(spark, tmp_path)
    assert ("b", "expired", "1", 11) in got and ("c", "added", "1", 140) in got and not any(r[:2] == ("a", "expired") for r in got)
    batch(spark, f"{tmp_path}/in", 4, [("b", "1", 150)])  # forgotten: it is new again
    got = turn(spark, tmp_path)
    assert [r for r in got if r[0] == "b" and r[1] == "added"] == [("b", "added", "1", 11), ("b", "added", "1", 150)]


def test_a_path_costs_few_calls_of_its_state():
    """each path made pandas frames, asked twice for its state and listed its timers, every batch."""
    import datetime

    calls = []

    class Kept:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def __getattr__(self, name):
            return lambda *_: Kept() if name == "getValueState" else calls.append(name)

    work = states.FileStates(100)
    work.init(Handle())
    at = lambda s: datetime.datetime.fromtimestamp(s)
    see = lambda *sights: [tuple(r) for r in work.handleInputRows(("a",), iter([{"digest": d, "at": at(s)} for d, s in sights]), None)]
    assert see(("2", 13), ("1", 10), (None, 14), ("1", 12)) == [("a", "added", "1", at(10)), ("a", "changed", "2", at(13)), ("a", "changed", None, at(14))]
    assert calls == ["get", "update", "registerTimer"]
    calls.clear()
    assert see((None, 14)) == [] and calls == ["get"]
    assert see((None, 20)) == [] and calls == ["get", "get", "update", "deleteTimer", "registerTimer"]
