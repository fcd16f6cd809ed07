"""Priorities, scores, clusters, debt, gates and verdicts over findings.

A finding has ``severity`` (info..critical), ``confidence`` (low..high),
``category`` and ``blocks``; other columns are the caller's.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the score.
SEVERITY = {"critical": 1.0, "high": 0.8, "medium": 0.55, "low": 0.3, "info": 0.1}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}
WEIGHTS = {"severity": 0.25, "reachability": 0.20, "probability": 0.15, "scope": 0.15, "detectability": 0.08, "cost": 0.08, "confidence": 0.01}
BLOCKING, MUST_FIX, SHOULD_FIX, MOST, DECAY = 8.0, 5.0, 2.5, 60.0, 300.0
HOURS = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5, "info": 0.1}
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
PRIORITY_ORDER = {"must-fix": 0, "should-fix": 1, "can-fix": 2}


def lookup(values: dict, column: Column, default) -> Column:
    return reduce(lambda c, kv: c.when(column == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(column == next(iter(values)), F.lit(next(iter(values.values()))))).otherwise(F.lit(default))


def priority() -> Column:
    sev, high = F.col("severity"), F.col("confidence") == "high"
    must = F.col("blocks") | ((sev == "critical") & high)
    should = sev.isin("critical", "high") | ((sev == "medium") & high)
    return F.when(must, "must-fix").when(should, "should-fix").otherwise("can-fix")


def priority_order() -> list[Column]:
    """Sort keys before the input's own ordinal: priority, severity, certain ones first."""
    return [lookup(PRIORITY_ORDER, F.col("priority"), 99), lookup(SEVERITY_ORDER, F.col("severity"), 99), (F.col("confidence") != "high").cast("int")]


# Words of paths and texts that raise a factor.
ENTRY_WORDS = ["api", "route", "routes", "controller", "handler", "service", "main", "entry", "public", "web"]
CORE_WORDS = ["core", "shared", "common", "domain", "service", "api", "controller", "handler", "infra", "platform"]
HISTORY_RULES = ["GIT-HOTSPOT", "OWNERSHIP-RISK", "LOW-CHANGE-COVERAGE"]
HISTORY_WORDS = ["hotspot", "coverage", "regression", "frequent", "history", "churn"]
# Factors by what holds first.
REACHABILITY = {"blocks": 1.0, "security entry": 0.95, "security or defect": 0.82, "project": 0.85, "entry": 0.78, "testing": 0.68, "else": 0.58}
PROBABILITY = {"history rule": 0.95, "history word": 0.88, "security or defect": 0.8, "testing": 0.76, "else": 0.6}
SCOPE = {"project": 1.0, "core": 0.9, "one part": 0.8, "else": 0.62}
DETECTABILITY = {"testing": 0.92, "security": 0.86, "no suggestion": 0.8, "low confidence": 0.45, "else": 0.62}
COST = {"blocks or security": 0.9, "core": 0.82, "maintainability or defect": 0.72, "else": 0.58}


def path_parts(path: Column) -> Column:
    clean = F.lower(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))))
    return F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))


def path_tokens(parts: Column) -> Column:
    """Words of all parts of a path, each without its extension."""
    stem = lambda p: F.regexp_replace(p, r"(?<=.)\.[^.]*$", "")
    return F.flatten(F.transform(parts, lambda p: F.split(stem(p), r"[\\\\._-]+")))


def folder_tokens(parts: Column) -> Column:
    """Words of all parts of a path but the last."""
    return F.flatten(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, r"[\\\\._-]+")))


def _words(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def _first(cases: list[tuple[Column, float]], other: float) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(other)


def place_factors(path: Column, text: Column, rule: Column, suggested: Column) -> dict[str, Column]:
    """Factors of a finding by its path, its words (title, cause, impact, tags), its rule and whether a test is suggested."""
    parts, words = path_parts(path), F.lower(F.coalesce(text, F.lit("")))
    known = lambda c: F.coalesce(c, F.lit(False))
    said = lambda which: words.rlike("|".join(which))
    return _factors(
        project=known(F.lower(F.trim(path)) == "project"), core=_words(folder_tokens(parts), CORE_WORDS), entry=_words(path_tokens(parts), ENTRY_WORDS), alone=F.size(parts) <= 1,
        entry_said=said(ENTRY_WORDS), history_said=said(HISTORY_WORDS), history_rule=known(rule.isin(HISTORY_RULES)), suggested=known(suggested),
    )


def plain_factors() -> dict[str, Column]:
    """Factors of findings without a path or text: inside some folder, with nothing suggested. Nothing of a path is evaluated."""
    no = F.lit(False)
    return _factors(project=no, core=no, entry=no, alone=no, entry_said=no, history_said=no, history_rule=no, suggested=no)


def _factors(*, project: Column, core: Column, entry: Column, alone: Column, entry_said: Column, history_said: Column, history_rule: Column, suggested: Column) -> dict[str, Column]:
    category, blocks = F.col("category"), F.coalesce(F.col("blocks"), F.lit(False))
    grave = category.isin("security", "defect")
    r, p, s, d, c = REACHABILITY, PROBABILITY, SCOPE, DETECTABILITY, COST
    return {
        "reachability": _first([(blocks, r["blocks"]), ((category == "security") & (entry | entry_said), r["security entry"]), (grave, r["security or defect"]), (project, r["project"]), (entry, r["entry"]), (category == "testing", r["testing"])], r["else"]),
        "probability": _first([(history_rule, p["history rule"]), (history_said, p["history word"]), (grave, p["security or defect"]), (category == "testing", p["testing"])], p["else"]),
        "scope": _first([(project, s["project"]), (core, s["core"]), (alone, s["one part"])], s["else"]),
        "detectability": _first([(category == "testing", d["testing"]), (category == "security", d["security"]), (~suggested, d["no suggestion"]), (F.col("confidence") == "low", d["low confidence"])], d["else"]),
        "cost": _first([(blocks | (category == "security"), c["blocks or security"]), (core, c["core"]), (category.isin("maintainability", "defect"), c["maintainability or defect"])], c["else"]),
    }


def deduction(factors: dict[str, Column] | None = None) -> Column:
    """Points that one finding takes, at most 60; needs ``priority``, severity, confidence, category and blocks."""
    all_ = {"severity": lookup(SEVERITY, F.col("severity"), 0.55), "confidence": lookup(CONFIDENCE, F.col("confidence"), 0.7), **plain_factors(), **(factors or {})}
    total = reduce(Column.__add__, [all_[k] * w for k, w in WEIGHTS.items()]) * 100.0
    total = total + F.when(F.col("blocks"), BLOCKING).otherwise(0.0) + F.when(F.col("priority") == "must-fix", MUST_FIX).when(F.col("priority") == "should-fix", SHOULD_FIX).otherwise(0.0)
    return F.least(F.lit(MOST), total)


def score(findings: DataFrame, group: list[str]) -> DataFrame:
    """``100 * 300 / (300 + sum of deductions)`` by group, one place; a group without findings would have 100.

    A column ``deduction`` of the findings is taken as it is.
    """
    rows = findings.withColumn("priority", priority())
    if "deduction" not in findings.columns:
        rows = rows.withColumn("deduction", deduction())
    return rows.groupBy(*group).agg(F.count("*").alias("findings"), F.sum(F.col("blocks").cast("int")).alias("blocking"), F.round(100.0 * DECAY / (DECAY + F.sum("deduction")), 1).alias("score"))


# Cluster of each rule, and of each category where the rule has none.
RULE_CLUSTERS = {
    "security:injection": ["SQL-INJECTION-RISK", "COMMAND-INJECTION-RISK", "PATH-TRAVERSAL-RISK", "SSRF-RISK"],
    "security:credential": ["HARDCODED-PASSWORD", "CONFIG-HARDCODED-SECRET", "ENV-FILE-TRACKED", "SENSITIVE-LOG-OUTPUT"],
    "security:crypto": ["WEAK-HASH", "INSECURE-RANDOM"],
    "performance:database": ["SQL-IN-LOOP", "SELECT-STAR-NO-LIMIT", "MISSING-PAGINATION", "TRANSACTION-SCOPE-TOO-LARGE"],
    "performance:concurrency": ["BUSY-WAIT", "RETRY-WITHOUT-BACKOFF", "MUTEX-LOCK-NO-UNLOCK", "UNBOUNDED-GOROUTINE", "REDOS-RISK"],
    "performance:timeout": ["HTTP-NO-TIMEOUT", "BLOCKING-CALL-IN-ASYNC"],
    "defect:exception": ["EMPTY-EXCEPT", "BROAD-EXCEPT", "BARE-EXCEPT", "LOG-ONLY-EXCEPT", "SWALLOWED-EXCEPTION-FLOW", "EXCEPTION-LOST-CONTEXT", "ASYNC-VOID"],
    "defect:resource": ["RESOURCE-LEAK", "RESOURCE-CLOSE-NOT-GUARANTEED"],
    "defect:logic": ["INFINITE-RECURSION-RISK", "INFINITE-LOOP-RISK", "DIVISION-BY-ZERO-RISK", "UNREACHABLE-CODE", "POSSIBLE-NONE-DEREF"],
    "architecture:coupling": ["CIRCULAR-DEPENDENCY", "HIGH-FAN-OUT", "UNSTABLE-DEPENDENCY", "HIGH-CLASS-COUPLING", "DIP-VIOLATION"],
    "architecture:design": ["GOD-CLASS", "DATA-CLASS", "DEEP-INHERITANCE", "ISP-VIOLATION", "FEATURE-ENVY"],
    "config:deployment": ["DEBUG-MODE-ENABLED", "DOCKERFILE-ROOT-USER", "DOCKER-LATEST-TAG", "CORS-WILDCARD", "MISSING-RESOURCE-LIMIT"],
    "maintainability:complexity": ["HIGH-CC-FUNCTION"],
}
CATEGORY_CLUSTERS = {"security": "security:injection", "performance": "performance:concurrency", "defect": "defect:exception", "architecture": "architecture:coupling", "config_risk": "config:deployment", "maintainability": "maintainability:complexity"}


def cluster_of(rule: Column, category: Column) -> Column:
    """Cluster by rule, else by category, else null."""
    out = F.lit(None).cast("string")
    for name, rules in RULE_CLUSTERS.items():
        out = F.when(rule.isin(rules), name).otherwise(out)
    return F.coalesce(out, lookup(CATEGORY_CLUSTERS, category, None))


def clusters(findings: DataFrame, cluster: str, module: str, smallest: int = 2, shown: int = 5) -> DataFrame:
    """Groups of at least ``smallest`` findings: size, worst severity, number of modules and the first few by name."""
    rank = lookup(SEVERITY_ORDER, F.col("severity"), 99)
    modules = findings.select(cluster, module).distinct().groupBy(cluster).agg(F.count(module).alias("modules"))
    sizes = findings.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size"), F.min_by("severity", rank).alias("worst")).where(F.col("size") >= smallest)
    first = first_members(findings, cluster, module, shown).withColumnRenamed(f"first_{module}", "first_modules")
    return sizes.join(modules, cluster).join(first, cluster)


def first_members(findings: DataFrame, cluster: str, column: str, shown: int) -> DataFrame:
    """``cluster, names``: the first distinct values by name, of which each task keeps only so many."""
    each = findings.where(F.col(cluster).isNotNull()).select(cluster, column).distinct()
    first = each.withColumn("n", F.row_number().over(Window.partitionBy(cluster).orderBy(column))).where(F.col("n") <= shown)
    return first.groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(f"first_{column}"))


def representatives(findings: DataFrame, cluster: str, key: str, shown: int = 3) -> DataFrame:
    """``cluster, place, key`` of the worst findings of each cluster, by severity and then key."""
    rank = lookup(SEVERITY_ORDER, F.col("severity"), 99)
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(rank, key))
    return findings.where(F.col(cluster).isNotNull()).withColumn("place", place).where(F.col("place") <= shown).select(cluster, "place", key)


def tech_debt(findings: DataFrame, group: list[str]) -> DataFrame:
    """Hours by severity and days of eight hours."""
    hours = F.sum(lookup(HOURS, F.col("severity"), 1.0))
    return findings.groupBy(*group).agg(F.count("*").alias("findings"), F.round(hours, 1).alias("hours"), F.round(hours / 8, 2).alias("days"))


def debt_report(findings: DataFrame, module: str, top: int = 10) -> DataFrame:
    """``kind, name, hours``: in total, by category, and the ``top`` modules by hours, then name."""
    hours = F.round(F.sum(lookup(HOURS, F.col("severity"), 1.0)), 1).alias("hours")
    total = findings.agg(F.coalesce(hours, F.lit(0.0)).alias("hours")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "hours")
    category = findings.groupBy("category").agg(hours).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "hours")
    modules = findings.groupBy(module).agg(hours).orderBy(F.desc("hours"), module).limit(top).select(F.lit("module").alias("kind"), F.col(module).alias("name"), "hours")
    return total.unionByName(category).unionByName(modules)


def gate_facts(findings: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    return findings.agg(F.count("*").alias("findings_total"), *[n(F.col("severity") == s).alias(f"findings_{s}") for s in SEVERITY], n(F.col("blocks")).alias("findings_blocking"), F.round(100.0 * DECAY / (DECAY + F.coalesce(F.sum("deduction"), F.lit(0.0))), 1).alias("project_score"))


#: Facts that are metrics of the project, and what stands in for a missing one.
METRIC_FACTS = {
    "test_coverage_line": "line_coverage",
    "test_line_coverage": "line_coverage",
    "test_coverage_branch": "branch_coverage",
    "test_branch_coverage": "branch_coverage",
    "test_coverage_function": "function_coverage",
    "test_function_coverage": "function_coverage",
    "test_coverage_change": "change_line_coverage",
    "duplication_overall_ratio": "duplication_rate",
    "duplication_new_ratio": "duplication_rate",
    "complexity_avg_cyclomatic": "cyclomatic_complexity",
    "complexity_avg_cc": "cyclomatic_complexity",
    "complexity_avg_cognitive": "cognitive_complexity",
    "maintainability_index": "maintainability_index",
    "evolution_churn_score": "churn_score",
}


def all_gate_facts(findings: DataFrame, metrics: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """One row of all facts that a gate's condition may name, dots written as underscores.

    ``findings``: severity, category, priority, deduction, blocking, is_test.
    ``metrics``: target_id, target_type, name, value, ordinal; the last of a name
    counts. ``modules``: score, is_test, has_blocking. ``files``: loc. Counts and
    scores are of production code.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("double")
    made, tests = ~F.col("is_test"), F.col("is_test")
    sev = F.col("severity")
    count = findings.agg(
        n(made).alias("findings_total"),
        n(made & F.col("blocking")).alias("findings_blocking"),
        n(made & (sev == "critical")).alias("findings_critical"),
        n(made & (sev == "high")).alias("findings_high"),
        n(made & (F.col("priority") == "must-fix")).alias("findings_must_fix"),
        n(made & (F.col("priority") == "should-fix")).alias("findings_should_fix"),
        n(made & (F.col("category") == "security") & (sev == "critical")).alias("security_critical"),
        n(tests).alias("scope_test_findings"),
        n(tests & F.col("blocking")).alias("scope_test_blocking"),
        F.round(100.0 * DECAY / (DECAY + F.coalesce(F.sum(F.when(made, F.col("deduction"))), F.lit(0.0))), 1).alias("project_overall_score"),
    )
    level = F.when(F.col("score") >= 85, "good").when(F.col("score") >= 70, "medium").when(F.col("score") >= 50, "high").otherwise("critical")
    scope = modules.agg(
        n(made).alias("scope_production_modules"),
        n(tests).alias("scope_test_modules"),
        F.min(F.when(made, F.col("score"))).alias("worst"),
        n(made & level.isin("high", "critical")).alias("risk_high_risk_modules"),
        n(made & (level == "critical")).alias("risk_critical_modules"),
        n(made & F.col("has_blocking")).alias("risk_blocking_modules"),
    )
    value = lambda name: F.max_by("value", F.when((F.col("target_id") == "project") & (F.col("name") == name), F.col("ordinal")))
    named = {m: value(m).alias(f"m_{m}") for m in {*METRIC_FACTS.values(), "core_module_score"}}
    high_cc = n((F.col("target_type") == "function") & (F.col("name") == "cyclomatic_complexity") & (F.col("value") >= 15)).alias("complexity_high_cc_functions")
    measured = metrics.agg(*named.values(), high_cc)
    sizes = files.agg(F.count("*").cast("double").alias("project_total_files"), F.coalesce(F.sum("loc"), F.lit(0)).cast("double").alias("project_total_loc"))
    row = F.broadcast(count).join(F.broadcast(scope)).join(F.broadcast(measured)).join(F.broadcast(sizes))  # one row each
    given = [F.coalesce(f"m_{m}", F.lit(0.0)).alias(fact) for fact, m in METRIC_FACTS.items()]
    score_of = F.col("project_overall_score")
    return row.select(
        *count.columns, *scope.columns[:2], *scope.columns[3:], "complexity_high_cc_functions", *sizes.columns, *given,
        F.col("complexity_high_cc_functions").alias("complexity_new_high_cc"),
        F.col("findings_blocking").alias("blocking_issues"),
        F.col("findings_total").alias("scope_production_findings"),
        F.col("findings_blocking").alias("scope_production_blocking"),
        F.col("m_line_coverage").isNull().alias("test_unavailable"),
        F.coalesce("m_core_module_score", score_of).alias("risk_core_module_score"),
        F.coalesce("worst", score_of).alias("risk_top_module_score"),
        F.coalesce("worst", score_of).alias("risk_worst_module_score"),
    )


_OPERATORS = {">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt}
_ATOM = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*(>=|<=|==|!=|>|<)\s*(?:(-?\d+(?:\.\d+)?)\s*%?|(?i:(true|false)))\s*$")


def gate_condition(text: str, facts: set[str]) -> Column:
    """``or`` of ``and`` of comparisons as a column; equality within 0.001; an atom that can't be read, or an unknown fact, is true."""

    def atom(part: str) -> Column:
        found = _ATOM.match(part)
        if not found or found[1].replace(".", "_") not in facts:
            return F.lit(True)
        fact = F.col(found[1].replace(".", "_"))
        if found[4]:  # a truth value: only == and != can hold
            same = fact.cast("boolean") == F.lit(found[4].lower() == "true")
            return same if found[2] == "==" else ~same if found[2] == "!=" else F.lit(False)
        fact, value = fact.cast("double"), float(found[3])
        if found[2] in ("==", "!="):
            near = F.abs(fact - value) < 0.001
            return near if found[2] == "==" else ~near
        return _OPERATORS[found[2]](fact, F.lit(value))

    ands = [reduce(Column.__and__, map(atom, re.split(r"\s+and\s+", part))) for part in re.split(r"\s+or\s+", text)]
    return reduce(Column.__or__, ands)


def gate(facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rule, action, passed`` of each ``(name, condition, action)`` on the one row of facts."""
    known = set(facts.columns)
    checks = [F.struct(F.lit(n).alias("rule"), F.lit(a).alias("action"), gate_condition(c, known).alias("passed")) for n, c, a in rules]
    return facts.select(F.inline(F.array(*checks)))


def _shown(fact: Column, kind: str) -> Column:
    return fact.cast("string") if kind == "boolean" else F.format_string("%.1f", fact.cast("double"))


def gate_messages(facts: DataFrame, threshold: float, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``kind, message``: what fails a release and what only warns, each message once, on the one row of facts.

    Three failures need no rule: a production score below the threshold, blocking
    findings, critical security findings. ``rules`` are ``(condition, action,
    message)``; in a message ``{actual}`` is the fact that the condition begins
    with, ``{total}``, ``{blocking}``, ``{critical}`` and ``{high}`` are counts,
    and a fact's name in braces is that fact. Actions other than fail and warn do
    nothing.
    """
    kinds = dict(facts.dtypes)
    whole = lambda name: F.col(name).cast("long").cast("string")
    counts = {"total": "findings_total", "blocking": "findings_blocking", "critical": "security_critical", "high": "findings_high"}

    def said(message: str, condition: str) -> Column:
        out = F.lit(message)
        first = re.match(r"\s*([A-Za-z_][\w.]*)", condition)
        fact = first[1].replace(".", "_") if first else ""
        known = {**{k: whole(v) for k, v in counts.items()}, **{c: _shown(F.col(c), k) for c, k in kinds.items()}}
        known["actual"] = _shown(F.col(fact), kinds[fact]) if fact in kinds else F.lit("unknown")
        for name in set(re.findall(r"\{(\w+)\}", message)) & known.keys():
            out = F.replace(out, F.lit("{" + name + "}"), known[name])
        return out

    failed = lambda test, message: F.struct(F.when(test, F.lit("fail")).alias("kind"), message.alias("message"))
    score_of = F.col("project_overall_score")
    found = [
        failed(score_of < threshold, F.concat(F.lit("score "), F.format_string("%.1f", score_of), F.lit(f" is below {threshold:g}"))),
        failed(F.col("findings_blocking") > 0, F.concat(whole("findings_blocking"), F.lit(" blocking findings"))),
        failed(F.col("security_critical") > 0, F.concat(whole("security_critical"), F.lit(" critical security findings"))),
    ]
    for condition, action, message in rules:
        if (kind := action.strip().lower()) in ("fail", "warn") and message:
            found.append(F.struct(F.when(~gate_condition(condition, set(facts.columns)), F.lit(kind)).alias("kind"), said(message, condition).alias("message")))
    return facts.select(F.inline(F.array(*found))).where("kind is not null").distinct()


def core_score(modules: DataFrame, overall: Column, top: int = 3) -> DataFrame:
    """One row: the lowest score of the modules with a core word in their path, else of the first ``top`` by score, findings, files and path; without modules ``overall``."""
    core = F.exists(path_parts(F.col("path")), lambda p: p.isin(CORE_WORDS))
    first = modules.orderBy("score", F.desc("findings"), F.desc("files"), "path").limit(top).agg(F.min("score").alias("first"))
    best = modules.where(core).agg(F.min("score").alias("core"))  # a row each
    return best.join(F.broadcast(first)).select(F.round(F.coalesce("core", "first", overall), 1).alias("core_module_score"))


def verdict(blocking: Column, score_column: Column, serious: Column) -> Column:
    """blocked, not_recommended (under 50), conditional (under 80 or serious findings) or recommended."""
    return F.when(blocking > 0, "blocked").when(score_column < 50, "not_recommended").when((score_column < 80) | (serious > 0), "conditional").otherwise("recommended")
