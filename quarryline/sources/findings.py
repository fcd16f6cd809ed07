"""Findings from elsewhere: baselines, other scanners' reports, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "struct<file_path:string,line_start:int,line_end:int>"
_FINDING = f"struct<rule_id:string,title:string,category:string,severity:string,location:{_PLACE}>"
_RESULT = "struct<check_id:string,path:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>,extra:struct<message:string,severity:string,metadata:struct<category:string,cwe:array<string>,owasp:array<string>,confidence:string>>>"
# Another scanner's grades, and the categories that it may give.
GRADES = {"ERROR": "high", "WARNING": "medium", "INFO": "low", "CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
CATEGORIES = {"security": "security", "performance": "performance", "correctness": "defect", "best-practice": "maintainability", "maintainability": "maintainability"}


def signature(rule: Column, path: Column, first: Column, last: Column) -> Column:
    """``rule::path::first::last``; nulls are empty or 0, a missing last line is the first."""
    text = lambda c: F.coalesce(c, F.lit(""))
    start = F.coalesce(first, F.lit(0))
    return F.concat_ws("::", text(rule), text(path), start.cast("string"), F.coalesce(last, start).cast("string"))


def semantic_key(category: Column, rule: Column, path: Column, title: Column) -> Column:
    """``category::rule::path::title`` in lower case, blanks of the title collapsed; lines play no part, so a moved finding keeps it."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.concat_ws("::", low(category), low(rule), low(path), F.trim(F.regexp_replace(low(title), r"\s+", " ")))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("report"), "value")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``signature`` of files that hold a list of findings, or an object with one under ``findings``; what cannot be read has none."""
    texts = _texts(spark, path)
    listed = F.coalesce(F.from_json("value", f"struct<findings:array<{_FINDING}>>")["findings"], F.from_json("value", f"array<{_FINDING}>"))
    rows = texts.select(F.explode(listed).alias("f")).where("f.rule_id is not null or f.location.file_path is not null")
    return rows.select(signature(F.col("f.rule_id"), F.col("f.location.file_path"), F.col("f.location.line_start"), F.col("f.location.line_end")).alias("signature")).distinct()


def scanner_report(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """``rule_id, path, line_no, line_end, title, severity, category, confidence, cwe_ids, owasp`` of another scanner's JSON reports.

    Paths lose ``root``; of ``CWE-611: text`` the id stays. Unknown grades are
    medium, unknown categories security; a result without a path is left out.
    """
    rows = _texts(spark, path).select(F.explode(F.from_json("value", f"struct<results:array<{_RESULT}>>")["results"]).alias("r")).where("r.path is not null")
    known = lambda table, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))
    clean = F.replace(F.col("r.path"), F.lit("\\"), F.lit("/"))
    head = root.rstrip("/") + "/"
    inside = F.when(clean.startswith(head), F.substring(clean, F.lit(len(head) + 1), F.length(clean))).otherwise(F.regexp_replace(clean, r"^\./", ""))
    cwe = F.array_distinct(F.filter(F.transform(F.coalesce("r.extra.metadata.cwe", F.array().cast("array<string>")), lambda x: F.upper(F.regexp_extract(x, r"(?i)cwe-\d+", 0))), lambda x: x != ""))
    return rows.select(
        F.col("r.check_id").alias("rule_id"),
        inside.alias("path"),
        F.coalesce("r.start.line", F.lit(1)).alias("line_no"),
        F.coalesce("r.end.line", "r.start.line", F.lit(1)).alias("line_end"),
        F.coalesce("r.extra.message", "r.check_id").alias("title"),
        known(GRADES, F.upper(F.coalesce("r.extra.severity", F.lit(""))), "medium").alias("severity"),
        known(CATEGORIES, F.lower(F.coalesce("r.extra.metadata.category", F.lit(""))), "security").alias("category"),
        F.lower(F.coalesce("r.extra.metadata.confidence", F.lit("medium"))).alias("confidence"),
        cwe.alias("cwe_ids"),
        F.coalesce("r.extra.metadata.owasp", F.array().cast("array<string>")).alias("owasp"),
    )


def newest(snapshots: DataFrame, scan: str, at: str, top: int) -> DataFrame:
    """The ``top`` newest scans, newest first: ``scan, at``."""
    return snapshots.groupBy(scan).agg(F.max(at).alias(at)).orderBy(F.desc(at), F.desc(scan)).limit(top)
