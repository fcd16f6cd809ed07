import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.llm import mixing, queries


def docs(spark, n=3000):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", None])
        text = " ".join("w" for _ in range(rng.choice([5, 80, 90, 900]))) + rng.choice(["", " ###", " License"])
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source, "x"))
    rows += [(n, None, "en", "a", "x"), (n + 1, "", "en", "a", "x"), (None, "some words", "en", "zz", "x"), (0, rows[0][1], rows[0][2], rows[0][3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string")


def check_marginals(rows):
    words = sum(r["words"] for r in rows)
    mass = sum(r["words"] * r["probability"] for r in rows)
    for margin, power in mixing.TEMPER.items():
        have, got = Counter(), Counter()
        for r in rows:
            have[r[margin]] += r["words"]
            got[r[margin]] += r["words"] * r["probability"]
        goal = {k: v**power for k, v in have.items() if v}
        for k, v in goal.items():
            assert abs(got[k] / mass - v / sum(goal.values())) < 2e-6, (margin, k)
    assert words and 0.999 < max(r["probability"] for r in rows) <= 1


def test_marginals_are_met(spark):
    df = docs(spark)
    out = mixing.mix(df)
    assert out.select("row.*").columns == df.columns
    check_marginals(out.collect())
    key = lambda r: (r["row"]["doc_id"] is None, r["row"]["doc_id"], r["kept"])
    assert sorted(map(key, out.collect())) == sorted((r.doc_id is None, r.doc_id, k) for r, k in [(r["row"], r["kept"]) for r in out.collect()])
    assert out.count() == df.count()


def test_many_cells_are_joined_with_salt(spark, monkeypatch):
    want = sorted(map(repr, mixing.mix(docs(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(map(repr, mixing.mix(docs(spark)).collect())) == want


def test_clashing_columns_pass_through(spark):
    names = ["_p", "_words", "_kept", "kept", "words", "row", "salt", "probability", "weight"]
    df = docs(spark, 50)
    wide = df.select("*", *[F.lit(n).alias(n) for n in names if n not in df.columns])
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert rows and all(r["_p"] == "_p" and r["row"] == "row" and r["words"] == "x" for r in rows)


def test_a_topic_column_is_the_topic(spark):
    df = docs(spark, 400).withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "t0").when(F.col("doc_id") % 3 == 1, "t1"))
    rows = mixing.mix(df).collect()
    assert {r["topic"] for r in rows} == {"t0", "t1", "unknown"}
    check_marginals(rows)


def test_given_targets(spark):
    out = mixing.mix(docs(spark), targets={"source": {"hot": 0.2, "a": 0.4, "b": 0.4}})
    got = {r["source"]: r["m"] for r in out.groupBy("source").agg(F.sum(F.col("words") * F.col("probability")).alias("m")).collect()}
    total = sum(got.values())
    assert abs(got["hot"] / total - 0.2) < 1e-5 and abs(got["a"] / total - 0.4) < 1e-5 and got["unknown"] == 0


def test_targets_that_cannot_be_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 16)
    rows = [(i, "some words here", lang, source) for i in range(20) for lang, source in (("en", "a"), ("de", "b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match="can't all be met"):
        mixing.mix(df, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}})


def test_sample_follows_probabilities(spark):
    rows = mixing.mix(docs(spark)).select("probability", "kept", "words").collect()
    expect, var = sum(r["probability"] for r in rows), sum(r["probability"] * (1 - r["probability"]) for r in rows)
    assert abs(sum(r["kept"] for r in rows) - expect) < 4 * var**0.5 + 1
    assert not any(r["kept"] for r in rows if r["words"] == 0)


def test_empty_and_very_long(spark):
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000, "en", "a"), (2, "word", "en", "a")], "doc_id long, text string, lang string, source string")
    assert sorted((r["words"], r["topic"]) for r in mixing.mix(long).collect()) == [(1, "note"), (200_000, "tract")]


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLES["op3_mixing"]).project("doc_id, topic, n_words, probability, kept").fetchall()
    got = [tuple(r) for r in queries.op3_mixing(spark, sf_dir).select("doc_id", "topic", "n_words", "probability", "kept").collect()]
    assert sorted(got) == sorted(want)


SCHEMA = "doc_id long, text string, lang string, source string"


def test_sources_of_one_language_each(spark):
    """Tempered goals of source and language contradict: the closest fit, with its residual, and no failure."""
    rows = [(i, "word " * (80 if i % 3 else 70), lang, source) for i, (lang, source) in enumerate([("en", "A")] * 200 + [("de", "B")] * 100)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 300 and any(r["kept"] for r in out)
    (off,) = {r["residual"] for r in out}
    mass = {s: sum(r["words"] * r["probability"] for r in out if r["source"] == s) for s in "AB"}
    have = {s: sum(r["words"] for r in out if r["source"] == s) for s in "AB"}
    share = mass["A"] / sum(mass.values())
    goal = lambda power: have["A"] ** power / sum(h**power for h in have.values())
    # with one free number the closest fit is the geometric mean of both goals
    assert abs(share - goal((mixing.TEMPER["source"] + mixing.TEMPER["lang"]) / 2)) < 1e-4
    assert abs(off - max(abs(share - goal(p)) for p in (mixing.TEMPER["source"], mixing.TEMPER["lang"]))) < 1e-4


def test_targets_without_a_category(spark):
    df = docs(spark, 300)
    out = mixing.mix(df, targets={"lang": {"xx": 1.0}}).collect()
    assert {r["residual"] for r in out if r["words"]} == {1.0} and any(r["kept"] for r in out)
    some = mixing.mix(df, targets={"source": {"hot": 0.5, "nowhere": 0.5}}).collect()
    assert all(r["probability"] == 0 for r in some if r["source"] != "hot")


def test_dotted_and_empty_input(spark):
    rows = [(i, "some words", "en", "a", 1) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA + ", n int").withColumnRenamed("n", "a.b`c")
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df).count() == 5
