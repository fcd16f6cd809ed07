"""Rules over lines and texts: matching, suppression, context, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def match_lines(lines: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row for each line and rule whose expression occurs in it: the columns of ``lines`` and ``rule_id``. Narrow."""
    hits = F.array(*[F.when(F.col("line").rlike(pattern), F.lit(rule)) for rule, pattern in rules.items()])
    return lines.withColumn("rule_id", F.explode(F.array_compact(hits)))


def unsuppressed(lines: DataFrame, key: str, hit: Column, marker: Column) -> DataFrame:
    """Hit lines without the marker on the line itself or the one directly above."""
    above = F.lag(marker.cast("boolean")).over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("_above", F.coalesce(above, F.lit(False))).where(hit & ~marker & ~F.col("_above")).drop("_above")


# Literals that stand for a secret, and words too weak to be one.
PLACEHOLDERS = ["changeme", "password", "secret", "your_secret_here", "your_api_key_here", "xxx", "todo", "fixme", "placeholder", "your_password_here", "replace_me", "none", "null", "undefined"]
WEAK_WORDS = ["admin", "administrator", "root", "localhost", "guest", "user", "test", "demo", "default", "qwerty", "letmein", "welcome", "12345", "123456", "123456789", "111111", "000000", "123321", "654321"]


def plausible_secret(value: Column) -> Column:
    """No placeholder, reference to a variable or weak word, and not under eight characters of digits or small letters alone; quotes do not count, an empty value is none."""
    bare = F.trim(F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", ""))
    low = F.lower(bare)
    simple = (F.length(low) < 8) & low.rlike("^(?:[0-9]+|[a-z]+)$")
    return ~((bare == "") | low.isin(PLACEHOLDERS) | bare.rlike("^[$%]") | low.isin(WEAK_WORDS) | simple)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Distinct by key; the first by a full order wins."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def presence_absence(df: DataFrame, text: str, present: list[str], absent: list[str]) -> DataFrame:
    """Rows whose whole text has all of ``present`` and none of ``absent``."""
    has = lambda p: F.col(text).rlike(p)
    return df.where(reduce(Column.__and__, [has(p) for p in present] + [~has(p) for p in absent], F.lit(True)))


def snippets(lines: DataFrame, hits: DataFrame, key: str, radius: int = 2) -> DataFrame:
    """``key, line_no, snippet`` of each hit: the lines within ``radius``, numbered, four digits wide.

    The hits are exploded to the line numbers wanted, so this is an equality join.
    """
    wanted = hits.select(key, "line_no", F.explode(F.sequence(F.col("line_no") - radius, F.col("line_no") + radius)).alias("at"))
    near = wanted.join(lines.select(key, F.col("line_no").alias("at"), "line"), [key, "at"])
    parts = F.array_sort(F.collect_list(F.struct("at", F.concat(F.lpad(F.col("at").cast("string"), 4, " "), F.lit(": "), F.col("line")).alias("s"))))
    return near.groupBy(key, "line_no").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n").alias("snippet"))


def select_rules(rules: DataFrame, allow: list[str] = (), deny: list[str] = (), with_tags: list[str] = (), without_tags: list[str] = (), min_severity: str = "info", language: str | None = None) -> DataFrame:
    """Rules that pass every given condition; ids, tags and languages compare in lower case. An empty list is no condition."""
    low = lambda xs: [x.lower() for x in xs]
    tags = F.transform("tags", F.lower)
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    keep = F.coalesce(F.element_at(rank, F.lower("severity")), F.lit(0)) >= SEVERITY_RANK[min_severity]
    if allow:
        keep &= F.lower("rule_id").isin(low(allow))
    if deny:
        keep &= ~F.lower("rule_id").isin(low(deny))
    if with_tags:
        keep &= F.arrays_overlap(tags, F.array(*map(F.lit, low(with_tags))))
    if without_tags:
        keep &= ~F.arrays_overlap(tags, F.array(*map(F.lit, low(without_tags))))
    if language:
        keep &= (F.size("languages") == 0) | F.array_contains(F.transform("languages", F.lower), language.lower())
    return rules.where(keep)
