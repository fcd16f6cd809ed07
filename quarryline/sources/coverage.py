"""Coverage reports as tables: ``report, path``, covered and total counts, executed and missing lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNTS = ("covered_lines", "num_statements", "covered_branches", "num_branches", "covered_functions", "num_functions")
_JSON = "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>, summary: struct<" + ", ".join(f"{c}: int" for c in _COUNTS) + ">>>"
_XML = "_filename string, methods struct<method: array<struct<`_line-rate`: double>>>, lines struct<line: array<struct<_number: int, _hits: int, _branch: string, `_condition-coverage`: string>>>"


def _counted(rows: DataFrame) -> DataFrame:
    return rows.where("total_lines <> 0 or total_branches <> 0 or total_functions <> 0")


def json_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports with a ``files`` map. A report that can't be read has no rows.

    Without a count of statements the executed and missing lines are counted;
    without a count of covered ones the missing lines are taken off the total.
    """
    texts = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("report"), F.from_json("value", _JSON).alias("r"))
    rows = texts.select("report", F.explode("r.files").alias("path", "f")).where("f is not null")
    lines = lambda c: F.coalesce(F.array_distinct(F.array_compact(f"f.{c}")), F.array().cast("array<int>"))
    rows = rows.select("report", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), lines("executed_lines").alias("executed"), lines("missing_lines").alias("missing"), *[F.coalesce(f"f.summary.{c}", F.lit(0)).alias(c) for c in _COUNTS])
    total = F.when(F.col("num_statements") == 0, F.size("executed") + F.size("missing")).otherwise(F.col("num_statements"))
    rows = rows.withColumn("total_lines", total)
    covered = F.when((F.col("covered_lines") == 0) & (F.col("total_lines") != 0) & (F.size("missing") > 0), F.greatest(F.col("total_lines") - F.size("missing"), F.lit(0))).otherwise(F.col("covered_lines"))
    return _counted(rows.select("report", "path", covered.alias("covered_lines"), "total_lines", "covered_branches", F.col("num_branches").alias("total_branches"), "covered_functions", F.col("num_functions").alias("total_functions"), "executed", "missing"))


def xml_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports with ``class`` elements, through Spark's own XML reader; branches from ``(a/b)`` of the condition coverage."""
    rows = spark.read.format("xml").option("rowTag", "class").schema(_XML).load(path).where("_filename <> ''")
    rows = rows.select(F.input_file_name().alias("report"), F.replace("_filename", F.lit("\\"), F.lit("/")).alias("path"), F.coalesce("lines.line", F.expr("cast(array() as array<struct<_number: int, _hits: int, _branch: string, `_condition-coverage`: string>>)")).alias("l"), F.coalesce("methods.method", F.expr("cast(array() as array<struct<`_line-rate`: double>>)")).alias("m"))
    part = lambda i: F.expr(f"aggregate(filter(l, x -> x._branch = 'true'), 0, (a, x) -> a + coalesce(try_cast(regexp_extract(x.`_condition-coverage`, '[(]([0-9]+)/([0-9]+)[)]', {i}) as int), 0))")
    hit = "coalesce(x._hits, 0) > 0"
    return _counted(
        rows.select(
            "report",
            "path",
            F.expr(f"size(filter(l, x -> {hit}))").alias("covered_lines"),
            F.size("l").alias("total_lines"),
            part(1).alias("covered_branches"),
            part(2).alias("total_branches"),
            F.expr("size(filter(m, x -> x.`_line-rate` > 0))").alias("covered_functions"),
            F.size("m").alias("total_functions"),
            F.expr(f"array_distinct(transform(filter(l, x -> {hit}), x -> x._number))").alias("executed"),
            F.expr(f"array_distinct(transform(filter(l, x -> not ({hit})), x -> x._number))").alias("missing"),
        )
    )


def latest(reports: DataFrame) -> DataFrame:
    """One row a path: the report of the last name."""
    rest = [c for c in reports.columns if c != "path"]
    return reports.groupBy("path").agg(F.max_by(F.struct(*rest), "report").alias("r")).select("path", "r.*")


def totals(rows: DataFrame) -> DataFrame:
    """Ratios of sums in per cent, one place; 0 for lines without a total, null for branches and functions without one."""
    def rate(kind: str, none):
        covered, total = F.sum(f"covered_{kind}"), F.sum(f"total_{kind}")
        return F.when(total > 0, F.round(100.0 * covered / total, 1)).otherwise(none).alias(kind)
    return rows.agg(rate("lines", F.lit(0.0)), rate("branches", F.lit(None).cast("double")), rate("functions", F.lit(None).cast("double")))


def changed_coverage(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``covered, total, percent`` over changed lines (``path, line_no``) that a report knows as executed or missing."""
    known = rows.select("path", F.explode(F.array_union(F.transform("executed", lambda x: F.struct(x.alias("line_no"), F.lit(True).alias("hit"))), F.transform("missing", lambda x: F.struct(x.alias("line_no"), F.lit(False).alias("hit"))))).alias("k"))
    lines = known.select("path", "k.line_no", "k.hit").groupBy("path", "line_no").agg(F.max("hit").alias("hit"))
    out = lines.join(changed.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi").agg(F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0)).alias("covered"), F.count("*").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("covered") / F.col("total"), 1)).otherwise(0.0))
