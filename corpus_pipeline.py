"""A corpus from raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again before the next stage starts. All stages but the last
return the columns of ``documents``.

In every stage null, empty and very long texts, null ids and repeated rows are
ordinary rows, judged as the stage's operator says; other columns of any name
pass through; an empty table gives an empty one. ``run`` deletes a stage's
scratch tables once its result has been written; those of a stage that is
called by itself last until the application ends.

Personal data, secrets, languages and repeated lines have operators of their
own (``op2``, ``op6``, ``op8``, ``op9``); the pipeline has no stage for them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import huffman, minhash, mixing, queries, toxicity, winnow
from quarryline.session import release, scratch_path, scratch_scope
from quarryline.sources.tables import table

#: SQL cannot express the trained toxicity stage; tests hold the rows against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of a toxicity score of 0.7 or more; without labels of both kinds, none."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: the one of the smallest id."""
    return minhash.deduplicated(docs, ngram=5, threshold=Fraction(4, 5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that share ten words in a row with a benchmark item, or all words of a shorter item."""
    return winnow.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that words meet the tempered source, language and topic weights."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the ids as files and reads them back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = scratch_path(spark, "corpus")
    huffman.write_ids(docs.select("doc_id", "text"), path, queries.word_tokenizer(), kept_words=50_000)
    return huffman.read_ids(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    for name, work in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope() as made:
            work(spark, docs, sf_dir).write.parquet(path)
        release(spark, written + made)  # the stage before has been read
        written = [path]
        docs = spark.read.parquet(path)
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(spark, written)
    return out
