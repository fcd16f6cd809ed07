"""Findings as they are shown and written: causes, ranks, scopes, snapshots, queues and graphs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import code, findings, review, triage
from quarryline.plans.graph_queries import SQL_PART_EDGES, part_edges
from quarryline.plans.score_queries import SQL_PAGES, pages_as_findings
from quarryline.session import scratch_path
from quarryline.sinks import reports
from quarryline.sources import files
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


@query(f"""WITH {SQL_PAGES} SELECT page_id, '[' || rule_id || '] ' || category || CASE WHEN words = '' THEN '' ELSE ' — ' || words END || CASE rule_id
  WHEN 'WEAK-HASH' THEN chr(10) || 'See: CWE-327 (https://cwe.mitre.org/data/definitions/327.html); OWASP A02:2021 (https://owasp.org/Top10/)'
  WHEN 'RESOURCE-LEAK' THEN chr(10) || 'See: CWE-772 (https://cwe.mitre.org/data/definitions/772.html); CWE-404 (https://cwe.mitre.org/data/definitions/404.html)'
  WHEN 'SQL-INJECTION-RISK' THEN chr(10) || 'See: CWE-89 (https://cwe.mitre.org/data/definitions/89.html); OWASP A03:2021 (https://owasp.org/Top10/)' ELSE '' END AS cause FROM (SELECT * REPLACE (['WEAK-HASH', 'RESOURCE-LEAK', 'SQL-INJECTION-RISK', 'LONG-FUNCTION'][page_id % 4 + 1] AS rule_id) FROM p)""")
def finding_causes(t):
    """Pages as findings of four rules, with the text of their cause."""
    rule = F.element_at(F.array(*map(F.lit, ["WEAK-HASH", "RESOURCE-LEAK", "SQL-INJECTION-RISK", "LONG-FUNCTION"])), (F.col("page_id") % 4).cast("int") + 1)
    return pages_as_findings(t).select("page_id", findings.cause(rule, F.col("category"), F.lower("words")).alias("cause"))


@query(f"""WITH {SQL_PAGES}, l AS (SELECT CASE WHEN rule_id IN ('{"', '".join(findings.CONFIRMED_RULES)}') THEN 4 WHEN confidence = 'high' THEN 3 WHEN confidence = 'medium' THEN 2 ELSE 1 END AS rank FROM p) SELECT rank, count(*) AS n FROM l GROUP BY 1""")
def evidence_ranks(t):
    rows = pages_as_findings(t).select(findings.evidence_rank(findings.evidence_level(F.col("rule_id"), F.col("confidence"))).alias("rank"))
    return rows.groupBy("rank").agg(F.count("*").alias("n"))


SQL_PATHS = "f AS (SELECT doc_id, CASE (doc_id + length(source)) % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/app/' WHEN 2 THEN '' WHEN 3 THEN 'lib/tests/' ELSE 'api\\' END || CASE n_chars % 4 WHEN 0 THEN 'test_' ELSE '' END || source || CASE n_chars % 3 WHEN 0 THEN '_test' WHEN 1 THEN '.spec' ELSE '' END || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.go' ELSE '.ts' END AS path FROM documents)"


def _paths(t) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, ["tests/", "src/app/", "", "lib/tests/", "api\\"])), ((F.col("doc_id") + F.length("source")) % 5).cast("int") + 1)
    end = F.when(F.col("n_chars") % 3 == 0, "_test").when(F.col("n_chars") % 3 == 1, ".spec").otherwise("")
    kind = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".go").otherwise(".ts")
    return t("documents").select("doc_id", F.concat(place, F.when(F.col("n_chars") % 4 == 0, "test_").otherwise(""), "source", end, kind).alias("path"))


@query(f"WITH {SQL_PATHS}, g AS (SELECT replace(path, chr(92), '/') AS p FROM f) SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '.' END AS module, count(*) AS n FROM g GROUP BY 1")
def modules_of_paths(t):
    return _paths(t).groupBy(findings.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_PATHS}, g AS (SELECT lower(replace(path, chr(92), '/')) AS p, regexp_extract(lower(replace(path, chr(92), '/')), '[^/]*$') AS n FROM f),
h AS (SELECT regexp_matches(p, '(^|/)(tests|__tests__)/') OR regexp_matches(n, '^test_|_test\\.py$|\\.(spec|test)\\.') AS gate, regexp_matches('/' || p, '/tests/') OR regexp_matches(n, '^test_|_test\\.py$|\\.spec\\.|\\.test\\.') AS suite,
  regexp_matches('/' || p, '/(test|tests|spec|specs|__tests__)/') OR regexp_matches(n, '^(test_|spec_)|_test\\.(go|py|java|js|ts)$|\\.(spec|test)\\.(js|ts)$') AS rules FROM g)
SELECT gate, suite, rules, count(*) AS n FROM h GROUP BY ALL""")
def test_scopes(t):
    """Paths by the three predicates of tests, which differ."""
    path = F.col("path")
    return _paths(t).groupBy(findings.is_test_path(path).alias("gate"), findings.is_test_name(path).alias("suite"), triage.is_test_file(path).alias("rules")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'go' WHEN 'fr' THEN 'cobol' ELSE 'rust' END AS language, count(*) AS n FROM documents GROUP BY 1)
SELECT language, n, row_number() OVER (ORDER BY CASE language WHEN 'go' THEN 3 WHEN 'python' THEN 5 WHEN 'rust' THEN 9 ELSE 10 END, language)::INT AS place FROM l""")
def languages_in_order(t):
    """Languages with their files, those of the first tiers first."""
    language = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "go").when(F.col("lang") == "fr", "cobol").otherwise("rust")
    counts = t("documents").groupBy(language.alias("language")).agg(F.count("*").alias("n"))
    return triage.numbered(counts, files.language_order(F.col("language")), "place").select("language", "n", F.col("place").cast("int").alias("place"))


@query(f"WITH {SQL_PAGES} SELECT page_id AS id, rule_id, severity, path FROM p")
def latest_snapshot(t):
    """Findings written as a snapshot and as the latest, of which the latest is read back after a second scan."""
    rows = pages_as_findings(t).select(F.col("page_id").alias("id"), "rule_id", "severity", "path")
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "snapshots")
    reports.write_latest(rows.limit(3), path, "one")
    reports.write_latest(rows, path, "two")
    return spark.read.schema(rows.schema).json(f"{path}/latest")


@query("SELECT event_id AS id, round(value, 2) AS points FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 500")
def queue_lines(t):
    """The dearest errors as a queue of JSON lines, read back."""
    rows = t("events").where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(500).select(F.col("event_id").alias("id"), F.round("value", 2).alias("points"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "queue")
    reports.write_queue(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(f"WITH {SQL_PART_EDGES} SELECT caller, count(*) AS calls, min(callee) AS first, max(confidence)::DOUBLE AS surest FROM pe GROUP BY 1")
def graph_lines(t):
    """Edges written as one JSON object a caller, read back."""
    edges = part_edges(t)
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "graph")
    reports.write_graph(edges, path)
    rows = spark.read.schema("caller long, calls array<struct<callee: long, confidence: double>>").json(path)
    return rows.select("caller", F.size("calls").cast("long").alias("calls"), F.col("calls")[0]["callee"].alias("first"), F.array_max(F.col("calls.confidence")).alias("surest"))


@query("SELECT o_orderkey AS id, ['ai-verified-true', NULL, 'ai-uncertain'][o_orderkey % 4] AS status FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderpriority <> '1-URGENT'")
def unrefused(t):
    """Orders as reviewed findings, without those that the review refused."""
    status = F.when(F.col("o_orderkey") % 4 == 1, "ai-verified-true").when(F.col("o_orderkey") % 4 == 3, "ai-uncertain").when((F.col("o_orderkey") % 4 == 0) & (F.col("o_orderpriority") == "1-URGENT"), "ai-verified-fp")
    return review.without_refused(t("orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


# Suppliers as files of three languages, each of which imports the file of the supplier of half its number.
SQL_IMPORTS = """s AS (SELECT s_suppkey AS k, s_suppkey // 2 AS other, s_suppkey % 3 AS kind FROM supplier),
p AS (SELECT k, other, kind, CASE kind WHEN 0 THEN 'src/n' || k % 5 || '/s' || k || '.py' WHEN 1 THEN 'src/main/java/org/n' || k % 5 || '/S' || k || '.java' ELSE 'cmd/n' || k || '/s.go' END AS path FROM s)"""


@query(f"WITH {SQL_IMPORTS} SELECT a.path AS source, b.path AS target FROM p a JOIN p b ON b.k = a.other AND b.kind = a.kind AND a.k <> b.k")
def import_edges(t):
    """Edges between files by the imports of their text; an import of a file of another language is external."""
    k, other = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 2)
    text = lambda n: n.cast("string")
    kind = k % 3
    path = F.when(kind == 0, F.concat(F.lit("src/n"), text(k % 5), F.lit("/s"), text(k), F.lit(".py"))).when(kind == 1, F.concat(F.lit("src/main/java/org/n"), text(k % 5), F.lit("/S"), text(k), F.lit(".java"))).otherwise(F.concat(F.lit("cmd/n"), text(k), F.lit("/s.go")))
    line = (
        F.when(kind == 0, F.concat(F.lit("from n"), text(other % 5), F.lit(".s"), text(other), F.lit(" import run")))
        .when(kind == 1, F.concat(F.lit("import org.n"), text(other % 5), F.lit(".S"), text(other), F.lit(";")))
        .otherwise(F.concat(F.lit('\t"example.org/shop/cmd/n'), text(other), F.lit('"')))
    )
    lang = F.when(kind == 0, "python").when(kind == 1, "java").otherwise("go")
    rows = t("supplier").select(path.alias("path"), lang.alias("lang"), line.alias("line"))
    return code.file_edges(rows, rows.select("path", "lang"))
