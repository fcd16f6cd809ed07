"""The registered queries of the text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import divergence, huffman, langid, linededup, minhash, mixing, pii, repair, secrets, simhash, sketch, toxicity, winnow
from quarryline.llm.common import crc32_mod, id_text
from quarryline.session import scratch_path
from quarryline.sources.tables import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return minhash.near_dedup(docs, ngram=3, threshold=Fraction(85, 100)).drop("class_id")


def op2_pii(spark: SparkSession, sf_dir: str, key: str = "quarryline") -> DataFrame:
    """The key is a parameter; a real one belongs in the deployment's secret store."""
    return pii.pseudonymise(id_text(table(spark, sf_dir, "documents")), key)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "topic", F.col("words").alias("n_words"), F.round("probability", 9).alias("probability"), "kept")


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(id_text(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=3, out_fold=1)
    out = toxicity.score(docs, chain, with_spans=False)
    held = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = langid.train(docs.where(crc32_mod(F.col("doc_id"), 5) != 0))
    return langid.held_out(langid.predict(docs.select("doc_id", "text"), model), 5)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_huffman(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = scratch_path(spark, "huffman")
    huffman.write_ids(id_text(table(spark, sf_dir, "documents")), path, tokenizer or word_tokenizer())
    return huffman.read_ids(spark, path)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(id_text(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(id_text(table(spark, sf_dir, "documents"))).drop("kept_text")


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(id_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return winnow.with_digest(found)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), ngram=3).select("doc_id", "fingerprint", "component_id")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    summary, turns = repair.repair(rows, rows["lives"])
    sums = repair.digests(repair.applied(turns, summary)).withColumnRenamed("conv_id", "digest_id")
    return summary.join(sums, summary["conv_id"].eqNullSafe(sums["digest_id"])).drop("digest_id")


QUERIES = {"op1_minhash": op1_minhash, "op2_pii": op2_pii, "op3_mixing": op3_mixing, "op4_sketch": op4_sketch, "op5_toxicity": op5_toxicity, "op6_langid": op6_langid, "op7_huffman": op7_huffman, "op8_secrets": op8_secrets, "op9_line_dedup": op9_line_dedup, "op10_winnow": op10_winnow, "op11_divergence": op11_divergence, "op12_simhash": op12_simhash, "op13_repair": op13_repair}
ORACLES: dict[str, str] = {"op1_minhash": minhash.ORACLE, "op10_winnow": winnow.ORACLE, "op3_mixing": mixing.oracle(), "op9_line_dedup": linededup.ORACLE, "op11_divergence": divergence.ORACLE, "op13_repair": repair.ORACLE}
