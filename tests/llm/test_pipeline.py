import zlib

import duckdb
import numpy as np
import pyarrow as pa
from test_huffman import plain
from test_minhash import brute as near_brute
from test_winnow import brute as winnow_brute

import corpus_pipeline
from quarryline.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def stage(spark, k, docs):
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
    return [tuple(r) for r in out.collect()]


def test_each_stage_and_the_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)
    rows = [tuple(r) for r in docs.collect()]

    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, chain).collect()}
    want = [r for r in rows if scores[r[0]] < 0.7]
    assert sorted(stage(spark, 0, docs)) == sorted(want) and len(want) < len(rows)

    label = near_brute([(r[0], r[1]) for r in want], 5, 4, 5)
    got, want = stage(spark, 1, frame(want)), [r for r in want if label[r[0]][2]]
    assert sorted(got) == sorted(want)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in winnow_brute([(r[0], r[1]) for r in want], items) if r[-1]}
    got, want = stage(spark, 2, frame(want)), [r for r in want if r[0] not in dirty]
    assert sorted(got) == sorted(want) and dirty

    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[i] for r in want] for i, c in enumerate(docs.columns)}))
    kept = {r[0] for r in con.sql(mixing.oracle()).project("doc_id, kept").fetchall() if r[1]}
    got, want = stage(spark, 3, frame(want)), [r for r in want if r[0] in kept]
    assert sorted(got) == sorted(want)

    final, start = [], 0
    want.sort()
    for r, ids in zip(want, plain(queries.word_tokenizer(), [r[1] for r in want]), strict=True):
        final.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(stage(spark, 4, frame(want))) == final
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == final


def test_odd_rows_pass_the_stages(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema.add("component_id", "string").add("_p2", "double")
    rows = [(None, None, None, None, None, None, None), (1, None, "en", "s", 0, "x", 1.0), (2, "", None, None, 0, None, None), (3, "one clean text here", "en", None, 4, None, None), (3, "one clean text here", "en", None, 4, None, None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, work in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(work(spark, docs, SF).collect(), schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
