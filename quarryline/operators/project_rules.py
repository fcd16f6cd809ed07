"""Findings about a project as a whole: histories, coverage, dependencies, build and configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import graph, metrics

# Thresholds.
HOT_COMMITS, HOT_LINES, VERY_HOT_COMMITS, VERY_HOT_LINES = 3, 20, 5, 60
OWNED_COMMITS, OWNED_SHARE, FULLY_OWNED_COMMITS, FULLY_OWNED_SHARE = 3, 0.8, 5, 0.95
PROJECT_COVERAGE, FILE_COVERAGE, CHANGE_COVERAGE = (80.0, 60.0), (60.0, 20.0), (80.0, 60.0)
MOST_FAN_OUT = 15


def _finding(rule: str, path: str | Column, grave: Column, value: Column) -> list[Column]:
    where = F.lit(path) if isinstance(path, str) else path
    return [F.lit(rule).alias("rule_id"), where.alias("path"), F.when(grave, "high").otherwise("medium").alias("severity"), value.cast("double").alias("value")]


def history_findings(files: DataFrame, top: int = 10) -> DataFrame:
    """``rule_id, path, severity, value`` of ``path, changed, commits, top_share``: files that change most, and files that one author owns.

    Each kind gives the first ``top``: hotspots by lines changed, commits, path;
    owned files by share, lines changed, path.
    """
    hot = files.where((F.col("commits") >= HOT_COMMITS) | (F.col("changed") >= HOT_LINES)).orderBy(F.desc("changed"), F.desc("commits"), "path").limit(top)
    owned = files.where((F.col("commits") >= OWNED_COMMITS) & (F.col("top_share") >= OWNED_SHARE)).orderBy(F.desc("top_share"), F.desc("changed"), "path").limit(top)
    very_hot = (F.col("changed") >= VERY_HOT_LINES) | (F.col("commits") >= VERY_HOT_COMMITS)
    wholly = (F.col("top_share") >= FULLY_OWNED_SHARE) & (F.col("commits") >= FULLY_OWNED_COMMITS)
    return hot.select(*_finding("GIT-HOTSPOT", F.col("path"), very_hot, F.col("changed"))).unionByName(owned.select(*_finding("OWNERSHIP-RISK", F.col("path"), wholly, F.col("top_share"))))


def coverage_findings(files: DataFrame, is_test: Column, changed_percent: DataFrame | None = None, top: int = 10) -> DataFrame:
    """``rule_id, path, severity, value`` of ``path, covered, total``: a project, files and changed lines that are covered too little.

    The project's share is of sums; files are the ``top`` least covered that are
    no tests: by share, larger total, path. ``changed_percent`` is one row
    ``percent``. Without lines there is nothing to find.
    """
    share = F.round(100.0 * F.col("covered") / F.col("total"), 1)
    whole = files.agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).where("total > 0").select(share.alias("percent"))
    out = whole.where(F.col("percent") < PROJECT_COVERAGE[0]).select(*_finding("LOW-PROJECT-COVERAGE", "project", F.col("percent") < PROJECT_COVERAGE[1], F.col("percent")))
    each = files.where((F.col("total") > 0) & ~is_test).withColumn("percent", share).where(F.col("percent") < FILE_COVERAGE[0])
    each = each.orderBy("percent", F.desc("total"), "path").limit(top)
    out = out.unionByName(each.select(*_finding("LOW-FILE-COVERAGE", F.col("path"), F.col("percent") < FILE_COVERAGE[1], F.col("percent"))))
    if changed_percent is not None:
        low = changed_percent.where(F.col("percent") < CHANGE_COVERAGE[0])
        out = out.unionByName(low.select(*_finding("LOW-CHANGE-COVERAGE", "project", F.col("percent") < CHANGE_COVERAGE[1], F.col("percent"))))
    return out


def dependency_findings(edges: DataFrame, depth: int = 10) -> DataFrame:
    """``rule_id, path, severity, value`` over ``source, target``: modules on a cycle, with too many targets, or that a stable one builds on though they are unstable."""
    links = edges.select(F.col("source").alias("caller"), F.col("target").alias("callee"))
    cycles = graph.in_cycle(links, depth).select(*_finding("CIRCULAR-DEPENDENCY", F.col("node"), F.lit(True), F.col("cycle_length")))
    fan = metrics.fan(edges).where(F.col("fan_out") > MOST_FAN_OUT)
    wide = fan.select(*_finding("HIGH-FAN-OUT", F.col("node"), F.lit(False), F.col("fan_out")))
    shaky = metrics.unstable(links).groupBy("caller").agg(F.count("*").alias("n")).select(*_finding("UNSTABLE-DEPENDENCY", F.col("caller"), F.lit(False), F.col("n")))
    return cycles.unionByName(wide).unionByName(shaky)


def build_file_findings(files: DataFrame, ignored: Column | None = None) -> DataFrame:
    """``rule_id, path, line_no`` over ``path, lang, content``: images that run as root, and files of environment variables that no ignore rule covers.

    ``ignored`` says whether a path is covered by an ignore rule; without it none is.
    """
    user = F.regexp_extract_all("content", F.lit(r"(?im)^\s*USER\s+(\S+)"), F.lit(1))
    last = F.try_element_at(user, F.lit(-1))
    image = files.where("lang = 'docker'").where(F.col("content").rlike(r"(?im)^\s*FROM\s") & (F.size(user) == 0) | last.rlike(r"^(?:root|0)(?::|$)"))
    name = F.element_at(F.split("path", "/"), -1)
    env = files.where(name.rlike(r"^\.env(?:\.(?!example$|sample$|template$|dist$)[\w.]+)?$") & ~(ignored if ignored is not None else F.lit(False)))
    hit = lambda df, rule: df.select(F.lit(rule).alias("rule_id"), "path", F.lit(1).alias("line_no"))
    return hit(image, "DOCKERFILE-ROOT-USER").unionByName(hit(env, "ENV-FILE-TRACKED"))
