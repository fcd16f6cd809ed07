"""Columns of any name, ids that repeat and labels without end, in the operators that hand rows on."""


import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import langid, minhash, pii, sampling, toxicity, winnow


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "x", "s", 1), (2, "one two three four five six", "x", "s", 2), (None, None, None, None, None), (3, "a b c d e f g h i j k l 10.1.2.3 mail me@there.example", "x", "s", 3), (3, "", "y", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
    return df.toDF("doc_id", "text", "lang", "source", "a.b`c").withColumn("c0", F.lit(1))


def test_columns_of_any_name_pass_through(spark, docs):
    items = spark.createDataFrame([(9, "a b c d e f g h i j")], "item_id long, text string")
    clean = winnow.uncontaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == 4
    fewer = minhash.deduplicated(docs)
    assert fewer.columns == docs.columns and sorted(r["doc_id"] for r in fewer.collect() if r["doc_id"]) == [1, 3, 3]
    kept = toxicity.reject(docs, toxicity.Chain(document=[-30.0, 0, 0, 0, 0, 0]))
    assert kept.columns == docs.columns and kept.count() == 5
    named = pii.pseudonymise(docs, "key")
    assert named.columns[: len(docs.columns)] == docs.columns and named.where(F.col("`a.b``c`") == 3).first()["n_email"] == 1


def test_pipeline_of_one_language_a_source(spark, tmp_path):
    rows = [(i, f"some text number {i} with words of its own {i * 7} {i * 11}", lang, source) for i, (lang, source) in enumerate([("en", "A"), ("de", "B")] * 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", "nothing that is there at all in any of the other texts")], "item_id string, text string").selectExpr("1L as item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_a_repeated_id_brings_one_row(spark):
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sample = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert sampling.collected(docs, sample, "toxic") == [("text 0", 1)]


def test_labels_without_end(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "en").otherwise(F.col("id").cast("string")).alias("lang"))
    got = sampling.bounded_sample(rows, "lang", 50, 0, most_labels=20).groupBy("lang").count().collect()
    assert len(got) == 20 and {r["count"] for r in got if r["lang"] != "en"} == {1}
    assert 20 <= next(r["count"] for r in got if r["lang"] == "en") <= 90
    few = sampling.bounded_sample(rows, "lang", 50, 0, most_labels=20, most_rows=200).where("lang = 'en'").count()
    assert few < 30


def test_language_model_of_a_dirty_column(spark):
    rows = [(i, "the house and the tree " * 3 if i % 2 else "das haus und der baum " * 3, ("en", "de")[1 - i % 2]) for i in range(60)] + [(100 + i, f"junk {i}", f"l{i}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=2)
    assert set(model.langs) == {"en", "de"}
