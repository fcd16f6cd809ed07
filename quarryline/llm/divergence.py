"""How far sources diverge from each other in their words, by an inverted index of corrections.

Within a language every source has a smoothed share ``p`` for each kept term,
and a pair's divergence is ``f(p, q)`` summed over all kept terms, exactly. Most
counts are zero, so a pair starts at the number of terms times ``f`` of its two
zero-count shares, and corrections are added:

* a term that one side alone has changes the sum by an amount that depends on
  its count and the other side's size only: emitted once for each distinct count
  of a source, times the number of its terms with that count;
* a term that both have: the postings of a term are joined with each other.

A term's postings are at most one a source. Terms are counted in Arrow batches
before anything is shuffled; all else is Spark's own functions. The terms that
set a source apart from its language are ranked by a window whose limit is
applied before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import slices
from quarryline.operators.joins import spread_join
from quarryline.session import materialize, release, scratch_scope

SCALE_A, SCALE_B = 31_250, 32_000  # shares are in units of one in SCALE_A * SCALE_B, which is 1,000,000,000
LEAST_DOCS = 3
TOP = 200
#: Terms that a task counts before it hands them on.
HELD = 200_000
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
KEYS = ["lang", "source"]


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and other characters beyond ASCII, A-Z in lower case."""
    return text.translate(LETTERS).split(b" ")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text, lang, source`` in; ``lang, source, term, n, docs`` out, ``docs`` the rows that hold the term."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        seen.clear()

    for part in slices(batches):
        for text, lang, source in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            n.update(found)
            docs.update(set(found))
            n.pop(b"", None)
        if sum(len(n) for n, _ in seen.values()) > HELD:
            yield from out()
    yield from out()


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (n + 1) / (total + kept))`` in two steps of long division, exact for counts up to 2.9e14."""
    of = F.nullif(total + kept, F.lit(0))
    left = (n + 1) * SCALE_A
    return 1 + _div(left, of) * SCALE_B + _div((left % of) * SCALE_B, of)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``. Sums over all terms stay within a long, as shares add up to little over 10^9."""
    return _div((p - q) * (p - q), q)


def postings(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, leads`` of the terms in at least ``least_docs`` rows of a language; ``leads`` marks one posting a term."""
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    # one shuffle by language and term serves both sums
    flat = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    flat = flat.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"), (F.row_number().over(term.orderBy("source")) == 1).alias("leads"))
    return flat.where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def sizes(rows: DataFrame, posted: DataFrame) -> DataFrame:
    """``lang, source, total, zero, kept, lang_total`` of every source, even one without terms; ``zero`` is the share of a count of 0, null without kept terms."""
    whole = posted.groupBy("lang").agg(F.sum(F.col("leads").cast("long")).alias("kept"), F.sum(F.when(F.col("leads"), F.col("lang_n"))).alias("lang_total"))
    own = posted.groupBy(*KEYS).agg(F.sum("n").alias("total"))
    every = rows.select(*KEYS).distinct().join(own, KEYS, "left").join(whole, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    return every.select("*", share(F.lit(0), F.col("total"), F.col("kept")).alias("zero"))


def pairs(posted: DataFrame, sources: DataFrame) -> DataFrame:
    """``lang, source, other, value`` of every ordered pair of sources of a language. ``posted`` has each posting's share ``p`` and its source's ``zero``."""
    others = sources.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    both_zero = gap(F.col("zero"), F.col("other_zero"))
    apart = F.col("source") != F.col("other")
    base = spread_join(sources.select(*KEYS, "zero", "kept"), others, ["lang"], ["source"], "inner").where(apart)
    base = base.select(*KEYS, "other", F.coalesce(F.col("kept") * both_zero, F.lit(0)).alias("value"))

    counts = posted.groupBy(*KEYS, "p", "zero").agg(F.count("*").alias("terms"))
    single = spread_join(counts, others, ["lang"], ["source", "p"], "inner").where(apart)
    single = single.select(
        *KEYS,
        "other",
        (F.col("terms") * (gap(F.col("p"), F.col("other_zero")) - both_zero)).alias("there"),
        (F.col("terms") * (gap(F.col("other_zero"), F.col("p")) - gap(F.col("other_zero"), F.col("zero")))).alias("back"),
    )

    a = posted.select("lang", "term", "source", "p", "zero")
    b = posted.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("zero").alias("other_zero"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "zero", "other_zero"))
    shared = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("other"))
    fix = lambda p, q, p0, q0: gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    shared = shared.groupBy(*KEYS, "other").agg(F.sum(fix(p, q, p0, q0)).alias("there"), F.sum(fix(q, p, q0, p0)).alias("back"))

    fixes = single.groupBy(*KEYS, "other").agg(F.sum("there").alias("there"), F.sum("back").alias("back")).unionByName(shared)
    there = fixes.select(*KEYS, "other", F.col("there").alias("value"))
    back = fixes.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value"))
    return base.unionByName(there).unionByName(back).groupBy(*KEYS, "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    Part ``pair`` ranks the other sources of the language by divergence, part
    ``term`` the ``top`` terms that a source has more of than its language.

    Nulls are the empty string; every row counts as a document, repeated ones
    too; a source without terms is ranked like any other, a language without
    kept terms has pairs of value 0; ties go by item. Very long texts: one at a
    time. Empty table: no rows. Other columns play no part.
    """
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("text"), empty("lang"), empty("source"))
    with scratch_scope() as made:
        found = materialize(postings(rows, least_docs), "postings")
        sources = materialize(sizes(rows, found), "sources")
        facts = sources.select(*KEYS, "total", "kept", "lang_total", "zero")
        posted = spread_join(found, facts, KEYS, ["term"], "inner").select(
            *KEYS, "term", "zero", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
        )
        order = Window.partitionBy(*KEYS).orderBy(F.desc("value"), "item")
        ranked = lambda part, df: df.select(*KEYS, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        near = ranked("pair", pairs(posted, sources).withColumnRenamed("other", "item"))
        own = posted.where("p > q").select(*KEYS, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        out = materialize(near.unionByName(ranked("term", own).where(F.col("rank") <= top)), "divergence")
    release(docs.sparkSession, made[:-1])  # all but the result
    return out


#: DuckDB SQL of the query over ``documents``: every share of every term, in whole.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lang_sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN n USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, (1 + 1000000000 * (coalesce(n.n, 0) + 1)::HUGEINT // (g.total + s.v))::HUGEINT AS p, (1 + 1000000000 * (k.lang_n + 1)::HUGEINT // (s.total + s.v))::HUGEINT AS q
  FROM groups g JOIN lang_sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM own) QUALIFY part = 'pair' OR rank <= 200"""
