"""Columns and roll-ups of findings, and links between findings, names and answers of a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.risk import SEVERITY_ORDER, deduction, lookup, priority, score
from quarryline.session import materialize

# Fixed values.
ENGINE_DIMENSION = {"structure": "scale", "metrics": "scale", "complexity": "complexity", "defect": "defects", "security": "security", "performance": "performance", "testing": "testing", "git": "evolution"}
CATEGORY_DIMENSION = {"security": "security", "defect": "defects", "maintainability": "complexity", "architecture": "architecture", "performance": "performance", "testing": "testing", "config_risk": "config_risk"}
CONFIRMED_RULES = ["SYNTAX-ERROR", "DIVISION-BY-ZERO-RISK", "COLLECTION-INDEX-OUT-OF-BOUNDS", "INFINITE-RECURSION-RISK", "EXCEPTION-NOT-RAISED", "SELF-ASSIGNMENT", "UNREACHABLE-CODE"]
EVIDENCE_RANK = {"test-confirmed": 5, "static-confirmed": 4, "likely": 3, "suspected": 2, "needs-review": 1}
VERDICTS = {"ai-verified-true": ["true", "real", "tp", "yes"], "ai-verified-fp": ["false", "fp", "no", "false_positive", "false-positive"], "ai-uncertain": ["uncertain", "unknown", "unsure"]}


def is_blocking(forced: Column, category: Column, severity: Column, confidence: Column) -> Column:
    """Forced, or certain and: security of high severity, or a critical defect, test or configuration risk. Null parts are false."""
    security = (category == "security") & severity.isin("critical", "high")
    other = category.isin("defect", "testing", "config_risk") & (severity == "critical")
    return F.coalesce(forced, F.lit(False)) | F.coalesce((confidence == "high") & (security | other), F.lit(False))


def evidence_level(rule: Column, confidence: Column) -> Column:
    return F.when(rule.isin(CONFIRMED_RULES), "static-confirmed").otherwise(lookup({"high": "likely", "medium": "suspected"}, confidence, "needs-review"))


def evidence_rank(level: Column) -> Column:
    return lookup(EVIDENCE_RANK, level, 0)


def dimension(engine: Column, category: Column) -> Column:
    """By engine, else by category, else ``other``."""
    by = lambda table, c: lookup(table, c, None)
    return F.coalesce(by(ENGINE_DIMENSION, engine), by(CATEGORY_DIMENSION, category), F.lit("other"))


def module_of(path: Column, none: str = ".") -> Column:
    """First segment, or ``none`` for a path without a slash."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(clean, F.lit("/")), F.split(clean, "/")[0]).otherwise(F.lit(none))


def is_test_path(path: Column) -> Column:
    """Below a folder of tests, or a file named as a test; null is not."""
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return p.rlike(r"(^|/)(tests|__tests__)/") | p.isin("test", "tests") | p.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.py|[^/]*\.(spec|test)\.[^/]*)$")


def is_test_name(path: Column) -> Column:
    """The predicate of test findings: below ``tests``, or a name that begins with ``test_``, ends with ``_test.py`` or has ``.spec.`` or ``.test.`` in it; null is not."""
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    folders, name = F.split(p, "/"), F.element_at(F.split(p, "/"), -1)
    below = F.array_contains(F.slice(folders, F.lit(1), F.size(folders) - 1), "tests")
    return below | name.startswith("test_") | name.endswith("_test.py") | F.contains(name, F.lit(".spec.")) | F.contains(name, F.lit(".test."))


# Weaknesses of the public list, and classes of the public top ten of 2021, that rules stand for.
WEAKNESSES = {
    "SQL-INJECTION-RISK": ["CWE-89"], "COMMAND-INJECTION-RISK": ["CWE-78"], "PATH-TRAVERSAL-RISK": ["CWE-22"], "SSRF-RISK": ["CWE-918"], "EVAL-USAGE": ["CWE-95"], "UNSAFE-DESERIALIZATION": ["CWE-502"],
    "HARDCODED-PASSWORD": ["CWE-798"], "CONFIG-HARDCODED-SECRET": ["CWE-798"], "WEAK-HASH": ["CWE-327"], "WEAK-CIPHER": ["CWE-327"], "INSECURE-RANDOM": ["CWE-330"], "INSECURE-TLS-VERIFICATION": ["CWE-295"],
    "SENSITIVE-LOG-OUTPUT": ["CWE-532"], "DEBUG-MODE-ENABLED": ["CWE-489"], "CORS-WILDCARD": ["CWE-942"], "DOCKERFILE-ROOT-USER": ["CWE-250"], "ENV-FILE-TRACKED": ["CWE-538"], "REDOS-RISK": ["CWE-1333"],
    "RESOURCE-LEAK": ["CWE-772", "CWE-404"], "POSSIBLE-NONE-DEREF": ["CWE-476"], "DIVISION-BY-ZERO-RISK": ["CWE-369"], "INFINITE-LOOP-RISK": ["CWE-835"], "DEAD-CODE": ["CWE-561"], "TAINT-CROSS-FUNCTION": ["CWE-20"],
}
TOP_TEN = {
    "SQL-INJECTION-RISK": ["A03:2021"], "COMMAND-INJECTION-RISK": ["A03:2021"], "EVAL-USAGE": ["A03:2021"], "PATH-TRAVERSAL-RISK": ["A01:2021"], "SSRF-RISK": ["A10:2021"], "UNSAFE-DESERIALIZATION": ["A08:2021"],
    "HARDCODED-PASSWORD": ["A07:2021"], "CONFIG-HARDCODED-SECRET": ["A07:2021"], "WEAK-HASH": ["A02:2021"], "WEAK-CIPHER": ["A02:2021"], "INSECURE-RANDOM": ["A02:2021"], "INSECURE-TLS-VERIFICATION": ["A07:2021"], "TAINT-CROSS-FUNCTION": ["A03:2021"],
}


def cause(rule: Column, title: Column, detail: Column, described: Column | None = None, weaknesses: Column | None = None, classes: Column | None = None, link: Column | None = None) -> Column:
    """A finding's cause in lines: what the rule is about, if that is ``described``; id, title and detail; weaknesses and classes with their addresses; a link.

    Weaknesses (``CWE-n``) and classes are arrays; without them the rule's own
    count. Parts that are null or empty are left out.
    """
    none = F.array().cast("array<string>")
    of_rule = lambda table: F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[rule], none)
    cwe = F.coalesce(weaknesses, of_rule(WEAKNESSES)) if weaknesses is not None else of_rule(WEAKNESSES)
    top = F.coalesce(classes, of_rule(TOP_TEN)) if classes is not None else of_rule(TOP_TEN)
    named = F.concat(F.lit("["), rule, F.lit("] "), F.coalesce(title, F.lit("")))
    head = F.when(F.length(F.coalesce(detail, F.lit(""))) > 0, F.concat(named, F.lit(" — "), detail)).otherwise(named)
    places = F.concat(
        F.transform(cwe, lambda c: F.concat(c, F.lit(" (https://cwe.mitre.org/data/definitions/"), F.replace(c, F.lit("CWE-"), F.lit("")), F.lit(".html)"))),
        F.transform(top, lambda c: F.concat(F.lit("OWASP "), c, F.lit(" (https://owasp.org/Top10/)"))),
    )
    refs = F.when(F.size(places) > 0, F.concat(F.lit("See: "), F.array_join(places, "; ")))
    more = F.when(F.length(link) > 0, F.concat(F.lit("More: "), link)) if link is not None else F.lit(None).cast("string")
    text = F.when(F.length(described) > 0, described) if described is not None else F.lit(None).cast("string")
    return F.array_join(F.array_compact(F.array(text, head, refs, more)), "\n")


def tokens(text: Column) -> Column:
    """Estimate of a text's tokens with its instructions."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4) + 500


def health(points: Column) -> Column:
    return F.when(points >= 75, "good").when(points >= 40, "warning").otherwise("critical")


def risk_level(points: Column) -> Column:
    return F.when(points >= 85, "good").when(points >= 70, "medium").when(points >= 50, "high").otherwise("critical")


def recommendation(blocking: Column, points: Column) -> Column:
    return F.when((blocking > 0) | (points < 50), "immediate_refactor").when(points < 80, "plan_refactor").otherwise("continue_observing")


def top_by(df: DataFrame, group: list[str], order: list, top: int) -> DataFrame:
    """The first rows of each group with their ``place``. Each task keeps its own first rows before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= top)


def dimension_scores(findings: DataFrame, metrics: DataFrame, title: str) -> DataFrame:
    """``dimension, score, status, findings, metrics, top_issues`` of every dimension that has findings or metrics.

    Findings need ``dimension``; metrics have ``dimension``. Without findings the score is 100.
    """
    scores = score(findings, ["dimension"]).select("dimension", "score", "findings")
    ranked = findings.withColumn("priority", priority())
    best = top_by(ranked, ["dimension"], [lookup(SEVERITY_ORDER, F.col("severity"), 5), "priority", title], 3)
    names = best.groupBy("dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(title).cast("string").alias("t")))), lambda x: x["t"]), ",").alias("top_issues"))
    counts = metrics.where("dimension is not null").groupBy("dimension").agg(F.count("*").alias("metrics"))
    out = scores.join(names, "dimension").join(counts, "dimension", "full").fillna({"score": 100.0, "findings": 0, "metrics": 0, "top_issues": ""})
    return out.select("dimension", "score", health(F.col("score")).alias("status"), "findings", "metrics", "top_issues")


def module_profiles(findings: DataFrame, module: str, kind: str) -> DataFrame:
    """Score, risk level, recommendation and commonest ``kind`` (the smaller on ties) of each module."""
    common = findings.groupBy(module, kind).agg(F.count("*").alias("n")).groupBy(module).agg(F.min(F.struct((-F.col("n")).alias("n"), kind))[kind].alias("dominant"))
    points = score(findings, [module])
    return points.join(common, module).select(module, "findings", "blocking", "score", risk_level(F.col("score")).alias("risk"), recommendation(F.col("blocking"), F.col("score")).alias("advice"), "dominant")


def module_top(findings: DataFrame, module: str, key: str, top: int = 5) -> DataFrame:
    """Worst findings of each module: severity, priority, larger deduction, key."""
    rows = findings.withColumn("priority", priority()).withColumn("deduction", F.round(deduction(), 6))
    rank = lookup({"must-fix": 0, "should-fix": 1, "can-fix": 2}, F.col("priority"), 3)
    return top_by(rows, [module], [lookup(SEVERITY_ORDER, F.col("severity"), 5), rank, F.desc("deduction"), key], top).select(module, "place", key, "severity", "priority")


def ownership_risk(owned: DataFrame, item: str, min_commits: int, min_share: float, top: int = 10) -> DataFrame:
    """Items mostly changed by one author: largest share, then most changed, then item."""
    found = owned.where((F.col("commits") >= min_commits) & (F.col("top_share") >= min_share))
    return found.orderBy(F.desc("top_share"), F.desc("changed"), item).limit(top)


def in_changed_files(findings: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Findings in changed paths, and those of the project as a whole (``project``, empty or null); no list keeps all."""
    if changed is None:
        return findings
    whole = F.coalesce("path", F.lit("")).isin("project", "")
    return findings.where(~whole).join(changed.select("path").distinct(), "path", "left_semi").select(findings.columns).unionByName(findings.where(whole))


def file_states(cached: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, state``: new, changed or deleted; what has not changed is left out."""
    both = cached.select(key, F.col(digest).alias("old")).join(now.select(key, F.col(digest).alias("new")), key, "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def nearest_match(rows: DataFrame, known: DataFrame, key: str, span: int = 3) -> DataFrame:
    """``key, line_no, match``: the known line that equals a row's, else the first within ``span`` lines from above.

    Rows are exploded to the lines in reach, so this is an equality join.
    """
    reach = rows.select(key, "line_no", F.explode(F.sequence(F.col("line_no") - span, F.col("line_no") + span)).alias("match"))
    found = reach.join(known.select(key, F.col("line_no").alias("match")).distinct(), [key, "match"])
    exact = (F.col("match") != F.col("line_no")).cast("int")
    return found.groupBy(key, "line_no").agg(F.min(F.struct(exact.alias("far"), "match"))["match"].alias("match"))


def chains(parents: DataFrame, node: str, parent: str, depth: int = 20) -> DataFrame:
    """``node, chain``: each node with its first parent's first parent and so on; ends at a root, a repeat or ``depth``.

    ``parents`` has one row a node. Only chains that still grow are joined again.
    """
    step = materialize(parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("_n"), F.col(parent).alias("_p")), "parents")
    front = parents.select(node, F.array(node).alias("chain"))
    done = None
    for _ in range(depth):
        tail = F.element_at("chain", -1)
        grown = materialize(front.join(step, tail == step["_n"], "left").withColumn("more", F.coalesce(~F.array_contains("chain", F.col("_p")), F.lit(False))).select(node, F.when(F.col("more"), F.array_append("chain", F.col("_p"))).otherwise(F.col("chain")).alias("chain"), "more"), "chain")
        ended = grown.where("not more").drop("more")
        done = ended if done is None else done.unionByName(ended)
        front = grown.where("more").drop("more")
        if front.isEmpty():
            return done
    return done.unionByName(front)


def resolve_calls(sites: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Targets of distinct calls (``path, class, callee``) among ``path, class, name, qualified``: the columns of ``sites``, ``target, confidence``.

    The first that holds: same file 0.95; imported (``imports``: ``path, name,
    target_path``) or same class 0.9; the only one of its name 0.6; else each of
    the first three by name 0.5.
    """
    ids = sites.distinct().withColumn("_site", F.xxhash64(*sites.columns))
    known = symbols.select(F.col("name").alias("callee"), F.col("path").alias("_path"), F.col("class").alias("_class"), "qualified")
    # candidates that can win: those near the call, and three of each name
    totals = known.groupBy("callee").agg(F.count("*").alias("_n"))
    first = top_by(known, ["callee"], ["qualified", "_path"], 3).drop("place").join(totals, "callee")
    # by path and by class apart: a name alone would pair every call with every symbol of that name
    by = lambda column, level: ids.join(known.select("callee", F.col(f"_{column}").alias(column), "qualified"), ["callee", column]).select(*ids.columns, F.lit(level).alias("confidence"), "qualified")
    own = by("path", 0.95).unionByName(by("class", 0.9))
    if imports is not None:
        brought = imports.select("path", F.col("name").alias("callee"), F.col("target_path").alias("_path")).distinct()
        own = own.unionByName(ids.join(brought, ["path", "callee"]).join(known.select("callee", "_path", "qualified"), ["callee", "_path"]).select(*ids.columns, F.lit(0.9).alias("confidence"), "qualified"))
    own = own.groupBy(*ids.columns).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "qualified")).alias("b")).select(*ids.columns, F.col("b.qualified").alias("target"), (-F.col("b.c")).alias("confidence"))
    rest = ids.join(own.select("_site"), "_site", "left_anti").join(first, "callee").select(*ids.columns, F.col("qualified").alias("target"), F.when(F.col("_n") == 1, 0.6).otherwise(0.5).alias("confidence"))
    return own.unionByName(rest).drop("_site")


def lookup_symbols(wanted: DataFrame, symbols: DataFrame, top: int = 3) -> DataFrame:
    """For each ``path, name`` wanted the first ``top`` symbols (``path, name, qualified, ordinal``) of that name: ``path, name, place, qualified``.

    Those of the same file come first, then those of the same folder, then the
    others, each in order. Of each name only the first ``top`` of all, those of
    the file and those of the folder are looked at.
    """
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    ids = wanted.select("path", "name").distinct().withColumn("folder", folder(F.col("path")))
    known = symbols.select("name", F.col("path").alias("_path"), folder(F.col("path")).alias("_folder"), "qualified", "ordinal")
    near = [
        ids.join(known.select("name", F.col("_path").alias("path"), "qualified", "ordinal"), ["name", "path"]).select("path", "name", F.lit(0).alias("rank"), "qualified", "ordinal"),
        ids.join(top_by(known.select("name", "_folder", "qualified", "ordinal").distinct(), ["name", "_folder"], ["ordinal", "qualified"], top).select("name", F.col("_folder").alias("folder"), "qualified", "ordinal"), ["name", "folder"]).select("path", "name", F.lit(1).alias("rank"), "qualified", "ordinal"),
        ids.join(top_by(known.select("name", "qualified", "ordinal").distinct(), ["name"], ["ordinal", "qualified"], top), "name").select("path", "name", F.lit(2).alias("rank"), "qualified", "ordinal"),
    ]
    every = reduce(DataFrame.unionByName, near).groupBy("path", "name", "qualified", "ordinal").agg(F.min("rank").alias("rank"))
    return top_by(every, ["path", "name"], ["rank", "ordinal", "qualified"], top).select("path", "name", "place", "qualified")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``path, module, target``: the file (``path, package``) that an import ``path, lang, module`` names; others are external.

    Python: the module, or what it is imported from; a leading dot is the
    importer's own package. Java: the class in its package. Go: a folder that the
    import's path ends with. Imports are turned into the keys that would match,
    so these are equality joins; the longest key wins.
    """
    parts = F.split("module", r"[./]")
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), "^(?:src|lib|source)/", ""), "/", ".")
    named = F.when(F.col("module").startswith("."), F.concat(own, F.regexp_replace("module", r"^\.+", ""))).otherwise(F.col("module"))
    python = F.array(named, F.regexp_replace(named, r"\.[^.]*$", ""))
    go = F.transform(F.sequence(F.lit(1), F.size(F.split("module", "/"))), lambda i: F.array_join(F.slice(F.split("module", "/"), i, F.size(F.split("module", "/"))), "/"))
    keys = F.when(F.col("lang") == "go", go).when(F.col("lang") == "java", F.array("module")).otherwise(python)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1)
    known = files.select(F.when(F.col("path").endswith(".java"), F.concat_ws(".", "package", stem)).otherwise(F.col("package")).alias("key"), F.col("path").alias("target")).where("key <> ''")
    found = imports.where(F.size(parts) > 0).select("path", "module", F.explode(F.array_distinct(keys)).alias("key")).join(known, "key").where("path <> target")
    longest = F.row_number().over(Window.partitionBy("path", "module").orderBy(F.desc(F.length("key")), "target"))
    return found.withColumn("n", longest).where("n = 1").select("path", "module", "target")


def in_modules(findings: DataFrame, modules: DataFrame, members: DataFrame) -> DataFrame:
    """Findings with each ``module`` (``module``, a folder; ``.`` is the root) that they belong to: by its files (``module, path``) or below its folder.

    A path is exploded to the folders above it, so this is an equality join.
    """
    clean = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    parts = F.split(clean, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = F.when(F.size(parts) == 1, F.array(F.lit("."), clean)).otherwise(above)
    below = findings.withColumn("module", F.explode(folders)).join(modules.select("module").distinct(), "module", "left_semi")
    listed = findings.join(members.select("module", "path").distinct(), "path")
    return below.select(*findings.columns, "module").unionByName(listed.select(*findings.columns, "module")).distinct()


def module_rollup(files: DataFrame, functions: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row a module: files, lines, code lines, functions, mean complexity, coverage, churn, commonest language, findings, score.

    ``files``: module, path, lang, loc, sloc; ``functions``: module, complexity;
    ``findings``: module and what a score needs; ``metrics``: module, name, value
    of files. A measure that a module has no value of is null; without findings
    the score is 100. Of equally common languages the first by name counts.
    """
    sizes = files.groupBy("module").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("sloc").alias("sloc"))
    common = files.where("lang is not null").groupBy("module", "lang").agg(F.count("*").alias("n")).groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("language"))
    inside = functions.groupBy("module").agg(F.count("*").alias("functions"), F.round(F.avg("complexity"), 1).alias("mean_complexity"))
    value = lambda name, how, out: F.round(how(F.when(F.col("name") == name, F.col("value"))), 1).alias(out)
    measured = metrics.groupBy("module").agg(value("line_coverage", F.avg, "coverage"), value("churn_score", F.sum, "churn"), value("duplication_rate", F.avg, "duplication"))
    points = score(findings, ["module"])
    out = sizes.join(common, "module", "left").join(inside, "module", "left").join(measured, "module", "left").join(points, "module", "left")
    out = out.fillna(0, ["functions", "findings", "blocking"]).fillna(0.0, ["mean_complexity"]).fillna(100.0, ["score"])
    return out.select("module", "files", "loc", "sloc", "functions", "mean_complexity", "coverage", "churn", "duplication", "language", "findings", "score", risk_level(F.col("score")).alias("risk"))


# Files and words that speak for a build tool, a framework or a test tool: kind, name, file, expression, weight.
HINTS = [
    ("build", "npm", "package.json", None, 5), ("build", "maven", "pom.xml", None, 5), ("build", "gradle", "build.gradle", None, 5), ("build", "gradle", "build.gradle.kts", None, 5), ("build", "cargo", "Cargo.toml", None, 5),
    ("build", "go", "go.mod", None, 5), ("build", "make", "Makefile", None, 3), ("build", "cmake", "CMakeLists.txt", None, 5), ("build", "pip", "requirements.txt", None, 4), ("build", "pyproject", "pyproject.toml", None, 5),
    ("framework", "django", "manage.py", None, 4), ("framework", "django", None, r"\bdjango\b", 2), ("framework", "flask", None, r"\bflask\b", 2), ("framework", "fastapi", None, r"\bfastapi\b", 2),
    ("framework", "spring", None, r"org\.springframework", 3), ("framework", "react", "package.json", '"react"', 3), ("framework", "vue", "package.json", '"vue"', 3), ("framework", "express", "package.json", '"express"', 3),
    ("framework", "gin", "go.mod", "gin-gonic/gin", 3), ("framework", "nodejs", "package.json", None, 1), ("framework", "dotnet", None, r"<Project Sdk=", 3),
    ("test", "pytest", None, r"import pytest", 4), ("test", "unittest", None, r"import unittest", 3), ("test", "junit", None, r"org\.junit", 4), ("test", "jest", "package.json", '"jest"', 4), ("test", "go test", None, r"testing\.T\b", 4),
]


def detected(files: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``kind, name, score``: what the files speak for, by ``hints`` (``kind, name, file, pattern, weight``), or those of the table above.

    A hint names a file, or gives an expression that a text has to have, or both;
    each hint counts once, however many files meet it. Hints are a short table.
    """
    if hints is None:
        hints = files.sparkSession.createDataFrame(HINTS, "kind string, name string, file string, pattern string, weight long")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("_name"), F.col("content").alias("_text"))
    meets = (F.col("file").isNull() | (F.col("file") == F.col("_name"))) & (F.col("pattern").isNull() | F.expr("_text rlike pattern"))
    met = rows.join(F.broadcast(hints), meets).select(*hints.columns).distinct()
    return met.groupBy("kind", "name").agg(F.sum("weight").alias("score"))


def in_engine_order(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All engines' findings with ``engine`` and its place; an engine that is not in the order comes last."""
    place = {e: i for i, e in enumerate(order)}
    return reduce(DataFrame.unionByName, [df.withColumn("engine", F.lit(e)).withColumn("engine_place", F.lit(place.get(e, len(order)))) for e, df in parts.items()])


def capped(findings: DataFrame, caps: dict[str, int], order: list) -> DataFrame:
    """At most so many findings of each rule that has a cap, the first in order; all of the others."""
    limit = lookup(caps, F.col("rule_id"), None)
    limited = findings.where(limit.isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order)))
    return limited.where(F.col("_n") <= limit).drop("_n").unionByName(findings.where(limit.isNull()))


def json_of(answer: Column) -> Column:
    """The JSON text in a model's answer: a fenced block, else from the first to the last brace, else the answer."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", F.trim(fenced)).when(braced != "", braced).otherwise(F.trim(answer))


def verdict_of(answer: Column) -> Column:
    """Status that a model's answer gives: its ``verdict`` in any case; null where there is none or it is not known."""
    said = F.lower(F.trim(F.from_json(json_of(answer), "verdict string, reason string")["verdict"]))
    out = F.lit(None).cast("string")
    for status, words in VERDICTS.items():
        out = F.when(said.isin(words), status).otherwise(out)
    return out
