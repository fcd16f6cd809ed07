"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted, in words, by cell (source, language, topic). Rounds of
raking scale the cells to each marginal's targets in turn, until they agree
with all three to ``AGREE`` of all words; that is measured. Where no weights
can agree with all (sources of one language each, whose targets and their
languages' contradict), rounds that scale to all marginals at once, by the
geometric mean of the three factors, go to the closest fit instead, and the
measured ``residual`` says how far off it is. A document's
inclusion probability is its cell's weight over its cell's words, scaled so that
the largest is 1; a keyed hash of the doc_id decides. Spark's own functions
only; the cells are one small table whatever the number of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import materialize, release, scratch_scope

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS = 12  # at least
MOST_ROUNDS = 200
ROUNDS_A_TABLE = 4
#: Raking has stalled when a table of rounds leaves more than this part of the largest difference.
STALLED = 0.9
#: Largest difference of a category's total from its goal, as a share of all words.
AGREE = 1e-6
#: A cell table of at most so many rows may be broadcast; a larger one is copied ``SALTS`` times, so that no cell's documents meet in one task.
BROADCAST_CELLS = 500_000
SALTS = 16
UNKNOWN = "unknown"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A plain topic by surface form: legal, table, noise, note (under 60 words), tract (over 800) or prose."""
    n = n_words(text)
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(F.contains(text, F.lit("License")), "legal")
        .when(F.regexp_count(text, F.lit(r" \| ")) * 5 >= n, "table")
        .when(text.rlike(r"!!|%%%|###|\*\*\*|&&&|\$\$\$"), "noise")
        .when(n < 60, "note")
        .when(n > 800, "tract")
        .otherwise("prose")
    )


def _targets(margin: str, given: dict[str, dict[str, float]] | None) -> Column:
    """Each cell's target total of its category: given shares of all words, or words to a power below 1."""
    if given and margin in given:
        shares = F.create_map(*[x for k, v in given[margin].items() for x in (F.lit(k), F.lit(float(v)))])
        return F.coalesce(F.element_at(shares, F.col(margin)), F.lit(0.0))
    return F.pow(F.col("words"), F.lit(TEMPER[margin]))


def residual(cells: DataFrame, margins: tuple[str, ...] | list[str] = MARGINS) -> float:
    """The largest difference of a category's weight from its goal, as a share of all words; 0 without cells."""
    gaps = [cells.groupBy(F.col(m).alias("category")).agg(F.abs(F.sum("weight") - F.first(f"goal_{m}")).alias("gap")) for m in margins]
    gap = reduce(DataFrame.unionAll, gaps).agg(F.max("gap")).first()[0]
    return (gap or 0.0) / (cells.agg(F.sum("words")).first()[0] or 1)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, agree: float = AGREE) -> DataFrame:
    """``cells(source, lang, topic, words)`` with a column ``weight`` raked to all marginals; weights sum to all words.

    ``targets`` may give ``{margin: {category: share}}``. A margin without is
    tempered: its categories' shares are in proportion to words to the power in
    ``TEMPER``. A category with words but no given share gets none.

    After ``rounds`` it goes on until the marginals agree, or until that stalls
    because no weights meet all the goals. It raises ValueError where given
    shares are the reason (as when a wanted source has words in unwanted
    languages only). Tempered goals give way: the closest fit is returned, with
    its ``residual`` (as in the function of that name) as a column. A given
    margin that names no category present asks for nothing that there is: it is
    left out, and the residual is 1.
    """
    empty = [m for m in targets or {} if m in MARGINS and not _present(cells, m, targets[m])]
    held = [m for m in MARGINS if m not in empty]
    total = cells.agg(F.sum("words").alias("total"))
    goals = cells
    for margin in held:
        goal = cells.groupBy(margin).agg(F.sum("words").alias("words"))
        goal = goal.select(margin, _targets(margin, targets).alias("raw"))
        scale = total.crossJoin(goal.agg(F.sum("raw").alias("all")))  # one row by one row
        goal = goal.join(F.broadcast(scale)).select(margin, (F.col("raw") / F.col("all") * F.col("total")).alias(f"goal_{margin}"))
        goals = goals.join(goal, margin)
    now = materialize(goals.withColumn("weight", F.col("words").cast("double")), "cells")
    done, gap, best, together = 0, 1.0, 2.0, False
    while held and (done < rounds or gap > agree) and done < MOST_ROUNDS:
        for _ in range(min(ROUNDS_A_TABLE, rounds - done) if done < rounds else ROUNDS_A_TABLE):
            now = _compromise(now, held) if together else reduce(_scaled, held, now)
            done += 1
        now = materialize(now, "raked")
        if together:  # its rounds do not keep the sum
            sums = now.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
            now = now.withColumn("weight", F.col("weight") * F.lit(sums["words"] / sums["weight"]))
        if done >= rounds:
            gap = residual(now, held)
            if together and gap > 0.99 * best:  # as close as it gets
                break
            if gap > agree and gap > STALLED * best:
                if targets and len(empty) < len(targets):
                    raise ValueError(f"the target weights can't all be met: after {done} rounds a category is off by {gap:.2g} of all words")
                together = True
            best = min(best, gap)
    return now.withColumn("residual", F.lit(1.0 if empty else gap))


def _factor(margin: str) -> Column:
    have = F.sum("weight").over(Window.partitionBy(margin))
    return F.when(have > 0, F.col(f"goal_{margin}") / have).otherwise(0.0)


def _scaled(cells: DataFrame, margin: str) -> DataFrame:
    return cells.withColumn("weight", F.col("weight") * _factor(margin))


def _compromise(cells: DataFrame, margins: list[str]) -> DataFrame:
    """One round to all marginals at once: it descends the sum of the marginals' divergences from their goals, whether or not all can be met."""
    for m in margins:
        cells = cells.withColumn(f"factor_{m}", _factor(m))
    mean = F.pow(reduce(lambda a, b: a * b, [F.col(f"factor_{m}") for m in margins]), F.lit(1.0 / len(margins)))
    return cells.withColumn("weight", F.col("weight") * mean).drop(*[f"factor_{m}" for m in margins])


def _present(cells: DataFrame, margin: str, shares: dict[str, float]) -> bool:
    wanted = [k for k, v in shares.items() if v > 0]
    return bool(wanted) and not cells.where(F.col(margin).isin(wanted)).isEmpty()


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """For each row of ``docs(doc_id, text, source, lang)``: the ``row`` itself, as a struct, and beside it
    ``source, lang, topic, words, probability, residual, kept``; ``residual`` is
    the largest difference of a category's weight from its goal, as a share of
    all words: under ``AGREE`` where all goals are met, more where they
    contradict each other and the closest fit is taken; null for rows without
    words.

    A column ``topic`` of the input, if there is one, is the topic; else its
    surface form is. Null sources, languages and topics are the category
    ``unknown``. Null or empty text has no words: its cell weighs nothing, its
    probability is 0. Null doc_ids are drawn as the id ``null``; rows of one
    doc_id are drawn alike. Very long texts are only counted. Other columns, of
    any name, pass through in ``row``. Empty table: no rows.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    kind = known("topic") if "topic" in docs.columns else topic(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), known("source").alias("source"), known("lang").alias("lang"), kind.alias("topic"), n_words(F.col("text")).alias("words"))
    with scratch_scope() as made:
        cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("words").alias("words")).where("words > 0"), "cells")
        raked = rake(cells, targets, rounds).select(*MARGINS, "residual", (F.col("weight") / F.col("words")).alias("ratio"))
        top = raked.agg(F.max("ratio").alias("top"))
        rates = materialize(raked.join(F.broadcast(top)).select(*MARGINS, "residual", F.when(F.col("top") > 0, F.col("ratio") / F.col("top")).otherwise(0.0).alias("probability")), "rates")
    release(docs.sparkSession, made[:-1])  # all but the rates
    if rates.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(rates), list(MARGINS), "left")
    else:
        copies = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col("row.doc_id").cast("string"), "words"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(copies, [*MARGINS, "salt"], "left").drop("salt")
    joined = joined.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    unit = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long") / float(16**12)
    return joined.select("row", *MARGINS, "words", "probability", "residual", (unit < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with all their columns."""
    return mix(docs, targets, seed).where("kept").select("row.*")


def oracle(rounds: int = ROUNDS, seed: int = 0) -> str:
    """DuckDB SQL of the default mix of ``documents``."""
    steps, last = [], "r0"
    for i in range(rounds * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT * REPLACE (weight * goal_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM {last})")
        last = f"r{i + 1}"
    goals = ", ".join(f"g_{m} AS (SELECT {m}, raw / sum(raw) OVER () * (SELECT sum(words) FROM cells) AS goal_{m} FROM (SELECT {m}, pow(sum(words), {TEMPER[m]}) AS raw FROM cells GROUP BY {m}))" for m in MARGINS)
    return f"""
WITH w AS (SELECT doc_id, text, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n FROM documents),
  d AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN contains(text, 'License') THEN 'legal'
    WHEN len(regexp_extract_all(text, ' \\| ')) * 5 >= n THEN 'table'
    WHEN regexp_matches(text, '!!|%%%|###|\\*\\*\\*|&&&|\\$\\$\\$') THEN 'noise'
    WHEN n < 60 THEN 'note' WHEN n > 800 THEN 'tract' ELSE 'prose' END AS topic FROM w),
  cells AS (SELECT source, lang, topic, sum(n)::BIGINT AS words FROM d GROUP BY ALL HAVING sum(n) > 0),
  {goals},
  r0 AS (SELECT cells.*, goal_source, goal_lang, goal_topic, words::DOUBLE AS weight FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
  {", ".join(steps)},
  p AS (SELECT source, lang, topic, weight / words / max(weight / words) OVER () AS p FROM {last})
SELECT doc_id, topic, n AS n_words, round(coalesce(p, 0), 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 12))::BIGINT / {16**12}.0 < coalesce(p, 0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
