"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a fixed fraction of the hash range.
Sketches of the same fraction merge by union, and the share of one sketch that
another holds estimates containment, however unequal the texts are. The main
path is made of Spark's own functions only.

A shingle is five words (all words where there are fewer). Of its 64-bit hash
the upper 32 bits are kept, as a signed integer. A text whose shingles all lie
above the threshold keeps its smallest one, so that only a text without words
has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.native import let, words
from quarryline.session import materialize

FRACTION = 1 / 4
NGRAM = 5


def sketch(text: Column, fraction: float = FRACTION, ngram: int = NGRAM) -> Column:
    """Sorted distinct retained hashes, ``array<int>``; empty for null or a text without words."""
    top = F.lit(int(-(2**31) + fraction * 2**32)).cast("int")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.slice(h, 1, F.size(h) - (ngram - 1)), lambda x, i: F.xxhash64(x, *[h[i + j] for j in range(1, ngram)]))
        upper = lambda x: F.shiftright(x, 32).cast("int")
        return F.transform(F.when(F.size(h) < ngram, F.array(F.xxhash64(h))).otherwise(runs), upper)

    def retained(s: Column) -> Column:
        below = F.array_sort(F.array_distinct(F.filter(s, lambda x: x < top)))
        return let(below, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(F.array_min(s))))

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        full = let(hashes, lambda h: let(shingles(h), retained))
        return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(full)

    return let(words(text), of_words)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    top = F.lit(int(-(2**31) + fraction * 2**32)).cast("int")
    both = F.array_sort(F.array_union(a, b))
    return let(both, lambda x: let(F.filter(x, lambda v: v < top), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.slice(x, 1, 1))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other one has; 1 for two empty sketches, 0 for one."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / small)


def printed(sketch_column: Column) -> Column:
    """The sketch as a string, eight hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch_column, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 0).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id`` for each distinct id: the next smaller one, and the largest after the smallest.

    Ids alone are dealt out by range; a window orders each range, and the ranges'
    ends, a row a range, are joined end to end.
    """
    spark = ids.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select("doc_id").distinct().repartitionByRange(ranges, "doc_id").select("doc_id", F.spark_partition_id().alias("r"))
    dealt = materialize(dealt, "ids")
    ends = dealt.groupBy("r").agg(F.max("doc_id").alias("top"))
    over = Window.orderBy("r")  # a row a range
    ends = ends.select("r", F.lag("top").over(over).alias("below"), F.max("top").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("largest"))
    within = F.lag("doc_id").over(Window.partitionBy("r").orderBy("doc_id"))
    return dealt.withColumn("before", within).join(F.broadcast(ends), "r").select("doc_id", F.coalesce("before", "below", "largest").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of each text with its last third exchanged.

    The last floor(n_chars / 3) code points of a text give way to as many from
    the start of the next document's, by descending doc_id; after the last one
    comes the first. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Null text is empty. A row with a null doc_id has no next document: its last
    third is cut, ``near_next`` is 0, and it is nobody's next. Repeated doc_ids:
    each row is returned; as a next document the id stands with its smallest
    text and smallest sketch. A single document is its own next. Empty table: no
    rows.

    Texts are shuffled once, and a third of each once more, with its sketch.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    own = docs.where("id is not null")
    links = neighbours(own.select(F.col("id").alias("doc_id")))
    lengths = own.groupBy(F.col("id").alias("doc_id")).agg(F.max(F.length("body")).alias("n"))
    links = materialize(links.join(lengths, "doc_id").select(F.col("next_id").alias("giver"), F.col("doc_id").alias("taker"), (F.col("n") / 3).cast("long").alias("n")), "links")
    # Both joins read one exchange of the bare texts. For that its two plans must be alike: new column names, since
    # an alias of the same name is dropped on one side of a self-join only, and sketches computed after the exchange.
    given = own.join(links.hint("shuffle_merge"), own.id == links.giver).select("taker", F.substring(F.col("body"), F.lit(1), F.col("n").cast("int")).alias("head"), sketch(F.col("body")).alias("next"))
    given = given.groupBy("taker").agg(F.min("head").alias("head"), F.min("next").alias("next"))
    whole = own.join(given.hint("shuffle_merge"), own.id == given.taker)
    lone = docs.where("id is null").select("id", "body", F.lit("").alias("head"), F.lit(None).cast("array<int>").alias("next"))
    rows = whole.select("id", "body", "head", "next").unionAll(lone).select(F.col("id").alias("doc_id"), F.col("body").alias("text"), "head", "next")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("head"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("sketch"), "next")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(containment(F.col("sketch"), F.col("next")), F.lit(0.0)).alias("near_next"),
    )
