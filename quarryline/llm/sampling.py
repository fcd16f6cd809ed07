"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a sample may have: those of most rows, ties by name.
MOST_LABELS = 256
#: Rows that a sample may have, of all labels together.
MOST_ROWS = 20_000


def bounded_sample(rows: DataFrame, label: str, per_label: int, seed: int, most_labels: int = MOST_LABELS, most_rows: int = MOST_ROWS) -> DataFrame:
    """About ``per_label`` rows of each label, picked by a hash of doc_id; all of a rarer label.

    Give it ids and labels, not texts, and join the texts to the result. It has
    the ``most_labels`` labels of most rows, and fewer rows of each where
    ``per_label`` of each would be more than ``most_rows``.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(most_labels)
    each = F.least(F.lit(per_label), F.lit(most_rows) / F.count("*").over(Window.partitionBy(F.lit(0))))  # over at most most_labels rows
    counts = counts.withColumn("_each", each)
    unit = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return rows.join(F.broadcast(counts), label).where(unit * F.col("_n") < F.col("_each")).drop("_n", "_each")


def collected(docs: DataFrame, sample: DataFrame, label: str, most_rows: int = MOST_ROWS) -> list:
    """``text`` and label of the sampled documents, in a fixed order; the bounded sample is broadcast, texts stay in place.

    Of the rows of one doc_id and label only the smallest text comes, and no
    more than twice ``most_rows`` in all, however the ids repeat.
    """
    picked = sample.groupBy("doc_id", label).count().drop("count").orderBy("doc_id", label).limit(2 * most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).collect()
    return [(r["text"], r[label]) for r in sorted(rows, key=lambda r: (r["doc_id"], str(r[label]), r["text"] or ""))]
