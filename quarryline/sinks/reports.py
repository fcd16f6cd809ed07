"""Findings as snapshots and as SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.risk import lookup

# Fixed values of the format.
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECURITY_SEVERITY = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "info": "1.0"}
PRECISION = {"high": "very-high", "medium": "high", "low": "medium"}


def write_snapshot(findings: DataFrame, path: str, scan_id: str) -> None:
    """One partition a scan; writing a scan again replaces it and no other."""
    findings.write.mode("overwrite").parquet(f"{path}/scan_id={scan_id}")


def write_latest(findings: DataFrame, path: str, scan_id: str) -> None:
    """A snapshot as JSON under the scan's name, and the same rows as ``latest``."""
    findings.write.mode("overwrite").json(f"{path}/snapshot-{scan_id}")
    findings.sparkSession.read.schema(findings.schema).json(f"{path}/snapshot-{scan_id}").write.mode("overwrite").json(f"{path}/latest")


def write_queue(rows: DataFrame, path: str) -> None:
    """One JSON object a line, most points first."""
    rows.orderBy(F.desc("points")).write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Each caller with its edges, as one JSON object a line."""
    edges.groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("callee", "confidence"))).alias("calls")).write.mode("overwrite").json(path)


def update_cache(spark: SparkSession, path: str, rows: DataFrame, key: str, made: str) -> None:
    """Adds entries to a cache kept as Parquet; an older entry of the same key gives way.

    Each update is a new version of the whole, written beside the old ones; the
    newest is the cache, so that readers never see half of one.
    """
    held = read_cache(spark, path)
    both = rows if held is None else held.unionByName(rows)
    rest = [c for c in rows.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), made).alias("e")).select(key, "e.*")
    newest.select(rows.columns).write.parquet(f"{path}/version={_versions(spark, path)[-1] + 1 if held is not None else 1}")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a cache, or None where there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [f.getPath() for f in store.listStatus(at)]
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def summary(findings: DataFrame) -> DataFrame:
    """``category, severity, n``: a row for each pair that occurs."""
    return findings.groupBy("category", "severity").agg(F.count("*").alias("n"))


def write_html(findings: DataFrame, path: str, title: str, top: int = 200) -> None:
    """One HTML page: counts by category and severity, and the first ``top`` findings by severity, path and line."""
    rank = lookup({"critical": 0, "high": 1, "medium": 2, "low": 3}, F.col("severity"), 4)
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), safe(c), F.lit("</td>"))], F.lit("</tr>"))
    table = lambda df, name: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["html"]), "\n").alias(name))
    counts = table(summary(findings).select(F.struct("category", lookup({"critical": 0, "high": 1, "medium": 2, "low": 3}, F.col("severity"), 4).alias("rank"), row(F.col("category"), F.col("severity"), F.col("n")).alias("html")).alias("r")), "counts")
    first = findings.orderBy(rank, "path", "line_start", "rule_id").limit(top)
    listed = table(first.select(F.struct(rank.alias("rank"), "path", "line_start", "rule_id", row(F.col("severity"), F.col("rule_id"), F.col("path"), F.col("line_start"), F.col("title")).alias("html")).alias("r")), "listed")
    head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{title}</title></head><body><h1>{title}</h1><table>"
    page = F.concat(F.lit(head), "counts", F.lit("</table><table>"), "listed", F.lit("</table></body></html>"))
    counts.join(F.broadcast(listed)).select(page.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def terminal_lines(findings: DataFrame, top: int = 20) -> list[str]:
    """A few lines for a terminal: the number of findings by severity and the first ``top`` of them."""
    counts = {r.severity: r.n for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}  # a row a severity
    rank = lookup({"critical": 0, "high": 1, "medium": 2, "low": 3}, F.col("severity"), 4)
    first = findings.orderBy(rank, "path", "line_start", "rule_id").limit(top).collect()
    return ["  ".join(f"{s}: {counts[s]}" for s in ("critical", "high", "medium", "low", "info") if s in counts), *[f"{r.severity:<8} {r.path}:{r.line_start or 1} {r.rule_id} {r.title}" for r in first]]


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``rule_id, rule``: one JSON descriptor for each rule, from its first finding by ``ordinal``."""
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct("title", "severity", "confidence", "category"), "ordinal").alias("f")).select("rule_id", "f.*")
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_id").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(lookup(LEVEL, F.col("severity"), "warning").alias("level")).alias("defaultConfiguration"),
        F.struct(F.array("category").alias("tags"), lookup(SECURITY_SEVERITY, F.col("severity"), "5.0").alias("security-severity"), lookup(PRECISION, F.col("confidence"), "medium").alias("precision")).alias("properties"),
    )
    return first.select("rule_id", F.to_json(rule).alias("rule"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """``ordinal, result``: one JSON result a finding; a missing start is line 1, a missing end the start."""
    start = F.coalesce("line_start", F.lit(1))
    place = F.struct(
        F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
        F.struct(start.alias("startLine"), F.coalesce("line_end", start).alias("endLine")).alias("region"),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        lookup(LEVEL, F.col("severity"), "warning").alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct("category", F.col("blocks").alias("blocks_release")).alias("properties"),
    )
    return findings.select("ordinal", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str) -> None:
    """A folder of one SARIF 2.1.0 text file a part.

    Each part is a run of its own with all rules, which number no more than the
    catalogue has; results are spread over the parts, so nothing is collected.
    """
    rules = sarif_rules(findings).agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    head = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":'), F.lit(json.dumps(tool)), F.lit(',"rules":['), F.col("rules"), F.lit(']}},"results":['))
    parts = sarif_results(findings).withColumn("part", F.floor(F.col("ordinal") / 5000)).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "result"))), lambda r: r["result"]), ",").alias("results"))
    parts.join(F.broadcast(rules)).select(F.concat(head, "results", F.lit("]}]}")).alias("value")).write.mode("overwrite").text(path)
