"""Scores, gates, roll-ups and the taking back of findings on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import around
from quarryline.operators import findings, risk, triage
from quarryline.operators.lines import explode_lines
from quarryline.plans.core_queries import SQL_FINDINGS, SQL_LINES_TABLE, SQL_SEVERITY, findings_of, lines_of
from quarryline.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of ``t``, which reads a table by name, with its SQL."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: table(spark, sf_dir, name))

        QUERIES[make.__name__] = run
        ORACLES[make.__name__] = sql
        return make

    return register


# Pages as findings: the address is the path, the markup the text.
_RULES = ["GIT-HOTSPOT", "WEAK-HASH", "OWNERSHIP-RISK", "SQL-IN-LOOP", "EMPTY-EXCEPT", "HIGH-CC-FUNCTION", "NONE"]
_CATEGORIES = ["security", "defect", "testing", "maintainability", "performance", "config_risk"]
_PLACES = ["service", "project", "src/core/main.go", "Web\\api-handler", "a", "src/platform.x/y.py", "lib/other/z.java", ".env", ""]


def _pick(names: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{key} % {len(names)} + 1]"


_WORDS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
SQL_PAGES = f"""p AS (SELECT page_id, {_pick(_CATEGORIES, 'page_id')} AS category, {_pick(list(risk.SEVERITY), '(page_id // 2)')} AS severity, {_pick(['high', 'medium', 'low'], '(page_id // 3)')} AS confidence, {_pick(_RULES, 'page_id')} AS rule_id,
  page_id % 11 = 0 AS blocks, page_id % 2 = 0 AS suggested, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE {_pick(_PLACES, 'page_id')} END AS path, lower(coalesce(regexp_extract(html, '<title>([^<]*)', 1), '')) AS words FROM pages),
q AS (SELECT *, list_filter(string_split(lower(trim(replace(path, chr(92), '/'))), '/'), lambda x: x <> '' AND x <> '.') AS parts, lower(trim(path)) = 'project' AS project FROM p),
w AS (SELECT *, list_has_any(flatten(list_transform(parts, lambda x: string_split_regex(regexp_replace(x, '^(.+)[.][^.]*$', '\\1'), '[\\\\._-]+'))), {_WORDS(risk.ENTRY_WORDS)}) AS entry,
  list_has_any(flatten(list_transform(parts[:len(parts) - 1], lambda x: string_split_regex(x, '[\\\\._-]+'))), {_WORDS(risk.CORE_WORDS)}) AS core, regexp_matches(words, '{"|".join(risk.ENTRY_WORDS)}') AS says_entry, regexp_matches(words, '{"|".join(risk.HISTORY_WORDS)}') AS says_history FROM q),
x AS (SELECT *, CASE WHEN blocks THEN 1.0 WHEN category = 'security' AND (entry OR says_entry) THEN 0.95 WHEN category IN ('security', 'defect') THEN 0.82 WHEN project THEN 0.85 WHEN entry THEN 0.78 WHEN category = 'testing' THEN 0.68 ELSE 0.58 END AS reachability,
  CASE WHEN rule_id IN ('GIT-HOTSPOT', 'OWNERSHIP-RISK', 'LOW-CHANGE-COVERAGE') THEN 0.95 WHEN says_history THEN 0.88 WHEN category IN ('security', 'defect') THEN 0.8 WHEN category = 'testing' THEN 0.76 ELSE 0.6 END AS probability,
  CASE WHEN project THEN 1.0 WHEN core THEN 0.9 WHEN len(parts) <= 1 THEN 0.8 ELSE 0.62 END AS scope,
  CASE WHEN category = 'testing' THEN 0.92 WHEN category = 'security' THEN 0.86 WHEN NOT suggested THEN 0.8 WHEN confidence = 'low' THEN 0.45 ELSE 0.62 END AS detectability,
  CASE WHEN blocks OR category = 'security' THEN 0.9 WHEN core THEN 0.82 WHEN category IN ('maintainability', 'defect') THEN 0.72 ELSE 0.58 END AS cost,
  CASE WHEN blocks OR (severity = 'critical' AND confidence = 'high') THEN 'must-fix' WHEN severity IN ('critical', 'high') OR (severity = 'medium' AND confidence = 'high') THEN 'should-fix' ELSE 'can-fix' END AS priority FROM w),
z AS (SELECT *, least(60.0, 100.0 * (0.25 * CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.55 WHEN 'low' THEN 0.3 ELSE 0.1 END + 0.2 * reachability + 0.15 * probability + 0.15 * scope + 0.08 * detectability + 0.08 * cost
  + 0.01 * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END) + CASE WHEN blocks THEN 8.0 ELSE 0 END + CASE priority WHEN 'must-fix' THEN 5.0 WHEN 'should-fix' THEN 2.5 ELSE 0 END)::DOUBLE AS deduction FROM x)"""


def pages_as_findings(t) -> DataFrame:
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (key % len(names)).cast("int") + 1)
    i = F.col("page_id")
    path = F.when(i % 3 == 0, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(pick(_PLACES, i))
    rows = t("pages").select(
        "page_id",
        pick(_CATEGORIES, i).alias("category"),
        pick(list(risk.SEVERITY), F.floor(i / 2)).alias("severity"),
        pick(["high", "medium", "low"], F.floor(i / 3)).alias("confidence"),
        pick(_RULES, i).alias("rule_id"),
        (i % 11 == 0).alias("blocks"),
        (i % 2 == 0).alias("suggested"),
        path.alias("path"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("words"),
    )
    factors = risk.place_factors(F.col("path"), F.col("words"), F.col("rule_id"), F.col("suggested"))
    rows = rows.withColumn("priority", risk.priority())
    return rows.withColumns(factors).withColumn("deduction", risk.deduction(factors))


@query(f"WITH {SQL_PAGES} SELECT page_id, priority, reachability::DOUBLE AS reachability, probability::DOUBLE AS probability, scope::DOUBLE AS scope, detectability::DOUBLE AS detectability, cost::DOUBLE AS cost, round(deduction, 6) AS deduction FROM z")
def score_factors(t):
    return pages_as_findings(t).select("page_id", "priority", "reachability", "probability", "scope", "detectability", "cost", F.round("deduction", 6).alias("deduction"))


@query(f"WITH {SQL_PAGES} SELECT category, count(*) AS findings, sum(blocks::INT)::BIGINT AS blocking, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM z GROUP BY 1")
def score_by_place(t):
    return risk.score(pages_as_findings(t), ["category"])


_CLUSTER = "CASE " + " ".join(f"WHEN rule_id IN ({', '.join(repr(r) for r in rules)}) THEN '{name}'" for name, rules in risk.RULE_CLUSTERS.items()) + " " + " ".join(f"WHEN category = '{c}' THEN '{name}'" for c, name in risk.CATEGORY_CLUSTERS.items()) + " END"


@query(f"""WITH {SQL_PAGES}, c AS (SELECT *, {_CLUSTER} AS cluster FROM z), s AS (SELECT cluster, count(*) AS size, arg_min(severity, {SQL_SEVERITY}) AS worst FROM c WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT cluster, array_to_string(list_sort(list(DISTINCT path))[1:10], ',') AS first_path FROM c GROUP BY 1),
r AS (SELECT cluster, string_agg(page_id::VARCHAR, ',' ORDER BY {SQL_SEVERITY}, page_id) AS shown FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {SQL_SEVERITY}, page_id) <= 3) GROUP BY 1)
SELECT cluster, size, worst, first_path, shown FROM s JOIN f USING (cluster) JOIN r USING (cluster)""")
def rule_clusters(t):
    rows = pages_as_findings(t).withColumn("cluster", risk.cluster_of(F.col("rule_id"), F.col("category")))
    rank = risk.lookup(risk.SEVERITY_ORDER, F.col("severity"), 99)
    sizes = rows.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("severity", rank).alias("worst")).where("size >= 2")
    shown = risk.representatives(rows, "cluster", "page_id").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("page_id").cast("string").alias("p")))), lambda x: x["p"]), ",").alias("shown"))
    return sizes.join(risk.first_members(rows, "cluster", "path", 10), "cluster").join(shown, "cluster").select("cluster", "size", "worst", "first_path", "shown")


_HOURS = "(CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.5 ELSE 0.1 END)::DOUBLE"


@query(f"""WITH {SQL_FINDINGS} SELECT 'total' AS kind, '' AS name, round(sum({_HOURS}), 1) AS hours FROM f UNION ALL SELECT 'category', category, round(sum({_HOURS}), 1) FROM f GROUP BY category
UNION ALL (SELECT 'module', module, round(sum({_HOURS}), 1) AS hours FROM f GROUP BY module ORDER BY hours DESC, module LIMIT 10)""")
def debt_report(t):
    return risk.debt_report(findings_of(t), "module")


# Nations as modules, those from P on as tests; suppliers as files.
SQL_GATE = f"""{SQL_FINDINGS}, y AS (SELECT *, module >= 'P' AS is_test, blocks OR (confidence = 'high' AND ((category = 'security' AND severity IN ('critical', 'high')) OR (category IN ('defect', 'testing') AND severity = 'critical'))) AS blocking FROM h),
u AS (SELECT module, module >= 'P' AS is_test, round(30000.0 / (300.0 + sum(deduction)), 1) AS score, bool_or(blocking) AS has_blocking FROM y GROUP BY 1),
k AS (SELECT sum((NOT is_test)::INT)::DOUBLE AS findings_total, sum((NOT is_test AND blocking)::INT)::DOUBLE AS findings_blocking, sum((NOT is_test AND severity = 'critical')::INT)::DOUBLE AS findings_critical, sum((NOT is_test AND severity = 'high')::INT)::DOUBLE AS findings_high,
  sum((NOT is_test AND priority = 'must-fix')::INT)::DOUBLE AS findings_must_fix, sum((NOT is_test AND priority = 'should-fix')::INT)::DOUBLE AS findings_should_fix, sum((NOT is_test AND category = 'security' AND severity = 'critical')::INT)::DOUBLE AS security_critical,
  sum(is_test::INT)::DOUBLE AS scope_test_findings, sum((is_test AND blocking)::INT)::DOUBLE AS scope_test_blocking, round(30000.0 / (300.0 + sum(deduction) FILTER (NOT is_test)), 1) AS project_overall_score FROM y),
m AS (SELECT sum((NOT is_test)::INT)::DOUBLE AS scope_production_modules, sum(is_test::INT)::DOUBLE AS scope_test_modules, min(score) FILTER (NOT is_test) AS worst, sum((NOT is_test AND score < 70)::INT)::DOUBLE AS risk_high_risk_modules,
  sum((NOT is_test AND score < 50)::INT)::DOUBLE AS risk_critical_modules, sum((NOT is_test AND has_blocking)::INT)::DOUBLE AS risk_blocking_modules FROM u),
v AS (SELECT sum((p_size >= 40)::INT)::DOUBLE AS high_cc, arg_max(p_size, p_partkey) FILTER (p_type = 'SMALL')::DOUBLE AS line, arg_max(p_size, p_partkey) FILTER (p_type = 'PROMO')::DOUBLE AS branch, arg_max(p_size, p_partkey) FILTER (p_type = 'LARGE')::DOUBLE AS dup FROM part),
l AS (SELECT count(*)::DOUBLE AS files, sum(s_suppkey)::DOUBLE AS loc FROM supplier),
a AS (SELECT k.*, scope_production_modules, scope_test_modules, risk_high_risk_modules, risk_critical_modules, risk_blocking_modules, high_cc AS complexity_high_cc_functions, files AS project_total_files, loc AS project_total_loc,
  coalesce(line, 0.0) AS test_coverage_line, coalesce(line, 0.0) AS test_line_coverage, coalesce(branch, 0.0) AS test_coverage_branch, coalesce(branch, 0.0) AS test_branch_coverage, 0.0::DOUBLE AS test_coverage_function, 0.0::DOUBLE AS test_function_coverage, 0.0::DOUBLE AS test_coverage_change,
  coalesce(dup, 0.0) AS duplication_overall_ratio, coalesce(dup, 0.0) AS duplication_new_ratio, 0.0::DOUBLE AS complexity_avg_cyclomatic, 0.0::DOUBLE AS complexity_avg_cc, 0.0::DOUBLE AS complexity_avg_cognitive, 0.0::DOUBLE AS maintainability_index, 0.0::DOUBLE AS evolution_churn_score,
  high_cc AS complexity_new_high_cc, findings_blocking AS blocking_issues, findings_total AS scope_production_findings, findings_blocking AS scope_production_blocking, line IS NULL AS test_unavailable, project_overall_score AS risk_core_module_score, worst AS risk_top_module_score, worst AS risk_worst_module_score
  FROM k, m, v, l)"""


def _gate_facts(t) -> DataFrame:
    rows = findings_of(t).withColumn("priority", risk.priority()).withColumn("deduction", risk.deduction())
    blocking = findings.is_blocking(F.col("blocks"), F.col("category"), F.col("severity"), F.col("confidence"))
    rows = rows.withColumn("is_test", F.col("module") >= "P").withColumn("blocking", blocking)
    modules = risk.score(rows, ["module"]).join(rows.groupBy("module").agg(F.max("blocking").alias("has_blocking")), "module").withColumn("is_test", F.col("module") >= "P")
    part = t("part").withColumn("ordinal", F.col("p_partkey"))
    project = part.select(F.lit("project").alias("target_id"), F.lit("project").alias("target_type"), risk.lookup({"SMALL": "line_coverage", "PROMO": "branch_coverage", "LARGE": "duplication_rate"}, F.col("p_type"), "other").alias("name"), F.col("p_size").cast("double").alias("value"), "ordinal")
    functions = part.where("p_size >= 40").select(F.col("p_name").alias("target_id"), F.lit("function").alias("target_type"), F.lit("cyclomatic_complexity").alias("name"), F.col("p_size").cast("double").alias("value"), "ordinal")
    return risk.all_gate_facts(rows, project.unionByName(functions), modules, t("supplier").select(F.col("s_suppkey").alias("loc")))


@query(f"WITH {SQL_GATE} SELECT * FROM a")
def all_gate_facts(t):
    return _gate_facts(t)


_GATE = [
    ("test.line_coverage >= 60% or test.unavailable == true", "fail", "coverage is {actual}"),
    ("complexity.high_cc_functions <= 5 and risk.high_risk_modules == 0", "fail", "{actual} complex functions, {total} findings"),
    ("findings.high < 1", "warn", "{high} of {findings_total}"),
    ("findings.high < 2", "warn", "{high} of {findings_total}"),
    ("no such thing", "fail", "never"),
    ("duplication.overall_ratio > 1000", "note", "nothing"),
]


@query(f"""WITH {SQL_GATE}, r AS (SELECT 'fail' AS kind, 'score ' || format('{{:.1f}}', project_overall_score) || ' is below 99.5' AS message FROM a WHERE project_overall_score < 99.5
UNION ALL SELECT 'fail', findings_blocking::BIGINT || ' blocking findings' FROM a WHERE findings_blocking > 0 UNION ALL SELECT 'fail', security_critical::BIGINT || ' critical security findings' FROM a WHERE security_critical > 0
UNION ALL SELECT 'fail', 'coverage is ' || format('{{:.1f}}', test_line_coverage) FROM a WHERE NOT (test_line_coverage >= 60 OR test_unavailable)
UNION ALL SELECT 'fail', format('{{:.1f}}', complexity_high_cc_functions) || ' complex functions, ' || findings_total::BIGINT || ' findings' FROM a WHERE NOT (complexity_high_cc_functions <= 5 AND risk_high_risk_modules = 0)
UNION ALL SELECT 'warn', findings_high::BIGINT || ' of ' || format('{{:.1f}}', findings_total) FROM a WHERE NOT findings_high < 2) SELECT kind, message FROM r""")
def gate_messages(t):
    return risk.gate_messages(_gate_facts(t), 99.5, _GATE)


_CORE = "lower(module) || CASE WHEN module IN ('NATION_3', 'NATION_7') THEN '/core' ELSE '' END"


@query(f"""WITH {SQL_FINDINGS}, s AS (SELECT {_CORE} AS path, count(*) AS findings, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM h GROUP BY ALL),
t AS (SELECT score FROM s ORDER BY score, findings DESC, path LIMIT 3), o AS (SELECT score FROM s WHERE path NOT LIKE '%/core' ORDER BY score, findings DESC, path LIMIT 3)
SELECT true AS named, round(coalesce((SELECT min(score) FROM s WHERE path LIKE '%/core'), (SELECT min(score) FROM t), 0.0), 1) AS core_module_score UNION ALL SELECT false, round((SELECT min(score) FROM o), 1)""")
def core_module_score(t):
    """With modules that are named as a core, and without."""
    scores = risk.score(findings_of(t), ["module"])
    path = F.concat(F.lower("module"), F.when(F.col("module").isin("NATION_3", "NATION_7"), "/core").otherwise(""))
    rows = scores.select(path.alias("path"), "score", "findings", F.lit(1).alias("files"))
    of = lambda df, named: risk.core_score(df, F.lit(0.0)).withColumn("named", F.lit(named))
    return of(rows, True).unionByName(of(rows.where(~F.col("path").endswith("/core")), False))


@query(f"""WITH {SQL_FINDINGS}, s AS (SELECT module, count(*) AS findings, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM h GROUP BY 1)
SELECT module, score, findings, row_number() OVER (ORDER BY score, findings DESC, module) AS place FROM s""")
def module_order(t):
    scores = risk.score(findings_of(t), ["module"]).select("module", "score", "findings")
    return triage.numbered(scores, [F.col("score"), F.desc("findings"), F.col("module")], "place")


@query(f"""WITH {SQL_LINES_TABLE}, m AS (SELECT doc_id, line_no, list_filter(string_split_regex(upper(trim(regexp_extract(line, '(###|%%%)[ \\t]*([A-Za-z0-9_, -]*)', 2))), '[,\\s]+'), lambda x: x <> '') AS ids FROM l WHERE regexp_matches(line, '###|%%%')),
s AS (SELECT doc_id, line_no + d AS line_no, unnest(CASE WHEN len(ids) = 0 THEN ['*'] ELSE ids END) AS id FROM m, (VALUES (0), (1)) x(d)),
h AS (SELECT doc_id, line_no, 'DOT' AS rule_id FROM l WHERE regexp_matches(line, '[.]$') UNION ALL SELECT doc_id, line_no, 'THE' FROM l WHERE regexp_matches(line, '^[Tt]he'))
SELECT doc_id::VARCHAR AS path, rule_id, line_no::INT AS line_no FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = h.doc_id AND s.line_no = h.line_no AND s.id IN ('*', h.rule_id))""")
def suppressed_by_id(t):
    """Marks ``###`` and ``%%%`` take back all rules, or those that are named behind them."""
    lines = lines_of(t).select(F.col("doc_id").cast("string").alias("path"), "line_no", "line")
    rule = F.explode(F.array_compact(F.array(F.when(F.col("line").rlike("[.]$"), F.lit("DOT")), F.when(F.col("line").rlike("^[Tt]he"), F.lit("THE"))))).alias("rule_id")
    return triage.not_suppressed(lines.select("path", rule, "line_no"), lines, [[]], "###|%%%")


_SOME_PATHS = ["tests/a.py", "src/Test_a.py", "src/a_test.go", "src/a.spec.ts", "spec/x/y.java", "src/contest.py", "test.py", "a/__tests__/b.js", "src/tests.py", "win\\tests\\a.py"]
_IN_TESTS = [1, 1, 1, 1, 1, 0, 0, 1, 0, 1]


@query(f"""WITH p AS (SELECT p_partkey, {_pick(_SOME_PATHS, 'p_partkey')} AS path, {_IN_TESTS}[p_partkey % {len(_SOME_PATHS)} + 1] = 1 AS is_test, {_pick(['PRINT-DEBUG', 'RESOURCE-LEAK', 'WEAK-HASH'], 'p_partkey')} AS rule_id FROM part)
SELECT path, is_test, rule_id, count(*) AS n, NOT (is_test AND rule_id <> 'RESOURCE-LEAK') AS counts FROM p GROUP BY ALL""")
def test_path_rules(t):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int") + 1)
    rows = t("part").select(pick(_SOME_PATHS).alias("path"), pick(["PRINT-DEBUG", "RESOURCE-LEAK", "WEAK-HASH"]).alias("rule_id"))
    return rows.groupBy("path", triage.is_test_file(F.col("path")).alias("is_test"), "rule_id", triage.counts_here(F.col("rule_id"), F.col("path")).alias("counts")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name, ['WEAK-HASH', 'RESOURCE-LEAK'][p_partkey % 2 + 1] AS rule_id, 10 * p_partkey + p_size % 10 AS line_no FROM part),
f AS (SELECT p_partkey, ['load_', 'cache_', 'token_', 'pick_'][p_partkey % 4 + 1] || replace(p_name, ' ', '_') AS name FROM part WHERE p_size % 3 > 0)
SELECT n.line_no, rule_id FROM n LEFT JOIN f USING (p_partkey) WHERE rule_id <> 'WEAK-HASH' OR f.name IS NULL OR regexp_matches(f.name, '^token') OR NOT regexp_matches(f.name, 'cache|pick')""")
def security_context(t):
    """A part is ten lines of one file; two of three have a function around them."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int") + 1)
    part, first = t("part"), (10 * F.col("p_partkey")).cast("int")
    hits = part.select(F.lit("f").alias("path"), pick(["WEAK-HASH", "RESOURCE-LEAK"]).alias("rule_id"), (first + F.col("p_size") % 10).alias("line_no"))
    functions = part.where("p_size % 3 > 0").select(F.lit("f").alias("path"), F.lit("function").alias("kind"), F.concat(pick(["load_", "cache_", "token_", "pick_"]), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), first.alias("start_line"), (first + 9).alias("end_line"))
    return triage.in_context(hits, functions).select("line_no", "rule_id")


@query(f"""WITH {SQL_LINES_TABLE}, h AS (SELECT doc_id, line_no, 'CSV-INJECTION' AS rule_id, 'quelle' AS quoted FROM l WHERE contains(line, ' | ')),
n AS (SELECT h.doc_id, h.line_no, bool_or(l.line_no BETWEEN h.line_no - 5 AND h.line_no + 5 AND contains(line, quoted)) AS named, coalesce(bool_or(regexp_matches(line, '(?i)escape|sanitiz|quote\\s*\\(|prepare|setString|allow_?list|secure_filename|normalize')) FILTER (l.line_no BETWEEN h.line_no - 10 AND h.line_no), false) AS cleaned
  FROM h JOIN l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 20 AND h.line_no + 20 GROUP BY 1, 2)
SELECT doc_id::VARCHAR AS path, line_no::INT AS line_no, CASE WHEN NOT named THEN 'its name is not there' ELSE 'value is cleaned' END AS reason FROM n WHERE NOT named OR cleaned""")
def likely_false_hits(t):
    lines = lines_of(t).select(F.col("doc_id").cast("string").alias("path"), "line_no", "line")
    hits = lines.where(F.contains("line", F.lit(" | "))).select("path", F.lit("CSV-INJECTION").alias("rule_id"), "line_no")
    return triage.likely_false(hits, lines, F.lit("quelle")).select("path", "line_no", "reason")


@query(f"""WITH {SQL_PAGES}, d AS (SELECT page_id FROM p WHERE page_id % 4 = 0) SELECT page_id, CASE WHEN hit THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END ELSE severity END AS severity, blocks AND NOT hit AS blocks,
CASE WHEN hit THEN 'likely-fp' ELSE '' END AS tags, CASE WHEN hit THEN 'needs-review' ELSE 'likely' END AS evidence_level FROM (SELECT p.*, page_id IN (SELECT page_id FROM d) AND category = 'security' AND page_id % 5 < 3 AS hit FROM p)""")
def lowered_findings(t):
    rows = pages_as_findings(t).select("page_id", F.col("page_id").cast("string").alias("path"), "rule_id", F.lit(1).alias("line_no"), F.when(F.col("page_id") % 5 < 3, "scanner").otherwise("own").alias("engine"), "category", "severity", "blocks", F.lit("likely").alias("evidence_level"), F.array().cast("array<string>").alias("tags"))
    doubtful = rows.where("page_id % 4 = 0").select("path", "rule_id", "line_no")
    return triage.lowered(rows, doubtful, "scanner").select("page_id", "severity", "blocks", F.array_join("tags", ",").alias("tags"), "evidence_level")


@query(f"""WITH {SQL_LINES_TABLE}, h AS (SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '###|!!')) SELECT doc_id, line_no::INT AS line_no, 'DOC-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id, 'text' AS engine FROM (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS n FROM h)""")
def finding_ids(t):
    hits = lines_of(t).where(F.col("line").rlike("###|!!")).select("doc_id", "line_no")
    return triage.finding_ids(hits, "text", "DOC", [F.col("doc_id"), F.col("line_no")])


@query("""SELECT doc_id, instr(text, 'License') AS at, substr(text, greatest(instr(text, 'License') - 200, 1), instr(text, 'License') + 200 - greatest(instr(text, 'License') - 200, 1)) AS near FROM documents WHERE contains(text, 'License')""")
def text_around(t):
    at = F.instr("text", "License")
    return t("documents").where(F.contains("text", F.lit("License"))).select("doc_id", at.alias("at"), around(F.col("text"), at).alias("near"))


@query(f"""WITH {SQL_LINES_TABLE}, h AS (SELECT lang, line, 'R1' AS rule_id FROM l WHERE regexp_matches(line, 'License|###')), k AS (SELECT * FROM (VALUES ('en', 'License', 'R1'), ('de', '###', 'R1'), ('en', ' | ', 'R1'), ('fr', 'License', 'R2')) x(lang, marker, rule_id))
SELECT k.lang, marker, rule_id, (SELECT count(*) FROM h WHERE h.lang = k.lang AND h.rule_id = k.rule_id AND contains(line, marker)) > 0 AS found FROM k""")
def labelled_markers(t):
    """Labels name a language, a rule and a part of the line; a finding of that rule on such a line meets the label."""
    labels = t("region").sparkSession.createDataFrame([("en", "License", "R1"), ("de", "###", "R1"), ("en", " | ", "R1"), ("fr", "License", "R2")], "lang string, marker string, rule_id string")
    hits = explode_lines(t("documents"), ["lang"]).where(F.col("line").rlike("License|###")).select("lang", "line", F.lit("R1").alias("rule_id"))
    met = hits.join(F.broadcast(labels), ["lang", "rule_id"]).where(F.contains("line", F.col("marker"))).select("lang", "marker", "rule_id").distinct().withColumn("found", F.lit(True))
    return labels.join(met, ["lang", "marker", "rule_id"], "left").fillna(False, ["found"])
