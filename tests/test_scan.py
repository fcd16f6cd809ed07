import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = [(k, i, rng.choice([-2, -1, 1, 1, None]), rng.choice([None, None, f"h{i}"]), rng.random() * 50) for k, n in (("hot", 900), ("b", 40), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(out, "k string, i int, d int, h string, at double")


@pytest.mark.parametrize("size", [7, 100, 10_000])
def test_scans_equal_windows(rows, size):
    upto = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda df, c: sorted((r["k"], r["i"], r[c]) for r in df.collect())
    s = rows.withColumn("s", F.sum(F.coalesce("d", F.lit(0))).over(upto))
    want = s.withColumn("v", (F.col("s") - F.least(F.lit(0), F.min("s").over(upto))).cast("long"))
    assert kept(scan.clamped_sum(rows, ["k"], ["i"], F.col("d"), "v", size), "v") == kept(want, "v")
    want = rows.withColumn("v", F.last("h", ignorenulls=True).over(upto))
    assert kept(scan.last_seen(rows, ["k"], ["i"], F.col("h"), "v", size), "v") == kept(want, "v")
    arrivals = {k: sorted((r.i, r.at) for r in rows.where(F.col("k") == k).collect()) for k in ("hot", "b", "c")}
    got = {(r["k"], r["i"]): r["start"] for r in scan.paced(rows, ["k"], ["i"], "at", 2.0, size=size).collect()}
    for k, coming in arrivals.items():
        free = -1e9
        for i, at in coming:
            free = max(at, free)
            assert abs(got[k, i] - free) < 2e-6
            free += 0.5


def test_one_key_is_many_ranges(rows):
    dealt = scan.ranged(rows, ["k"], ["i"], 50)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert dealt.where("k = 'hot'").select("_range").distinct().count() > 10 and max(sizes) < 200
    ends = dealt.groupBy("_range").agg(F.min(F.struct("k", "i")).alias("lo"), F.max(F.struct("k", "i")).alias("hi")).orderBy("_range").collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))


def test_no_rows(rows):
    assert scan.paced(rows.limit(0), ["k"], ["i"], "at", 1.0).count() == 0
    assert scan.clamped_sum(rows.limit(0), ["k"], ["i"], F.col("d"), "v").columns == [*rows.columns, "v"]
