"""Links between names, files, modules and findings, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import code, findings, graph
from quarryline.plans.code_queries import files_of, lines_in, projects_of, values
from quarryline.plans.core_queries import SQL_EDGES, SQL_FINDINGS, SQL_LINES_TABLE, edges_of, findings_of, lines_of
from quarryline.sources import files as source_files
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


# Suppliers as files in the folders of their nations, parts as symbols in them.
SQL_SYMBOLS = "y AS (SELECT DISTINCT s_nationkey || '/' || s_suppkey || '.py' AS path, s_nationkey || '/' AS folder, p_brand AS name, p_name || '.' || p_partkey AS qualified, p_partkey AS ordinal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48)"


def _symbols(t) -> DataFrame:
    rows = t("lineitem").where("l_quantity > 48").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    return rows.select(path.alias("path"), F.col("p_brand").alias("name"), F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("qualified"), F.col("p_partkey").alias("ordinal")).distinct()


@query(f"""WITH {SQL_SYMBOLS}, w AS (SELECT DISTINCT path, folder, name FROM y WHERE ordinal % 3 = 0),
c AS (SELECT w.path, w.name, y.qualified, y.ordinal, min(CASE WHEN y.path = w.path THEN 0 WHEN y.folder = w.folder THEN 1 ELSE 2 END) AS rank FROM w JOIN y ON y.name = w.name GROUP BY ALL)
SELECT path, name, row_number() OVER (PARTITION BY path, name ORDER BY rank, ordinal, qualified)::INT AS place, qualified FROM c QUALIFY place <= 3""")
def symbol_lookup(t):
    symbols = _symbols(t)
    return findings.lookup_symbols(symbols.where("ordinal % 3 = 0"), symbols)


_IMPORTED = [
    ("src/app/a.py", "python", "app.dao.user", "src/app/dao/user.py"),
    ("src/app/a.py", "python", "app.dao.user.User", "src/app/dao/user.py"),
    ("src/app/a.py", "python", ".dao.user", "src/app/dao/user.py"),
    ("src/app/a.py", "python", "os.path", None),
    ("src/main/java/com/x/A.java", "java", "com.y.B", "src/main/java/com/y/B.java"),
    ("src/main/java/com/x/A.java", "java", "java.util.List", None),
    ("cmd/main.go", "go", "example.com/shop/pkg/dao", "pkg/dao/user.go"),
    ("cmd/main.go", "go", "fmt", None),
]
_KNOWN = [("src/app/a.py", "python"), ("src/app/dao/user.py", "python"), ("src/main/java/com/x/A.java", "java"), ("src/main/java/com/y/B.java", "java"), ("cmd/main.go", "go"), ("pkg/dao/user.go", "go")]


@query(f"SELECT path, module, target, count(*) AS n FROM part JOIN {values([(i, p, m, x) for i, (p, _, m, x) in enumerate(_IMPORTED)])} e(i, path, module, target) ON p_partkey % {len(_IMPORTED)} = i WHERE target IS NOT NULL GROUP BY 1, 2, 3")
def import_targets(t):
    spark = t("region").sparkSession
    known = spark.createDataFrame(_KNOWN, "path string, lang string").select("path", source_files.package_of(F.col("path"), F.col("lang")).alias("package"))
    rows = files_of(t, [(f"{i}", lang, m) for i, (_, lang, m, _) in enumerate(_IMPORTED)], "part", "p_partkey")
    places = F.element_at(F.array(*[F.lit(p) for p, *_ in _IMPORTED]), F.element_at(F.split("path", "/"), -1).cast("int") + 1)
    imports = rows.select(places.alias("path"), "lang", F.col("content").alias("module"))
    counts = imports.groupBy("path", "module").agg(F.count("*").alias("n"))
    return findings.resolve_imports(imports.distinct(), known).join(counts, ["path", "module"])


_MODULES = [("a.py", "python", "import b\nfrom c import x\nimport b\nimport os\n"), ("b.py", "python", "from a import y\n"), ("c.py", "python", "import b.inner\nimport c\n")]


@query("SELECT s_suppkey || '.' || s AS source, s_suppkey || '.' || x AS target FROM supplier, (VALUES ('a', 'b'), ('a', 'c'), ('b', 'a')) e(s, x)")
def module_imports(t):
    """Edges between modules of one project a supplier, whose number is part of each module's name."""
    files = projects_of(t, _MODULES)
    number = F.substring_index("path", "/", 1)
    lines = lines_in(files).withColumn("line", F.regexp_replace("line", r"^(import|from) (\w)", "$1 N.$2")).withColumn("line", F.replace("line", F.lit("N."), F.concat(number, F.lit("."))))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(import|from) (\d+)\.", "$1 m$2."))
    known = files.select("path", F.concat(F.lit("m"), number, F.lit("."), F.regexp_extract("path", r"/(\w+)\.", 1)).alias("module"))
    edges = code.module_edges(lines, known)
    return edges.select(F.substring("source", 2, 99).alias("source"), F.substring("target", 2, 99).alias("target"))


@query("""WITH f AS (SELECT o_orderkey, ['src', 'src/api', 'lib', ''][o_orderkey % 4 + 1] AS d, o_custkey FROM orders), p AS (SELECT o_orderkey, CASE WHEN d = '' THEN '' ELSE d || '/' END || o_custkey || '.py' AS path, d FROM f),
m AS (SELECT path, o_orderkey, unnest(CASE d WHEN 'src' THEN ['src'] WHEN 'src/api' THEN ['src', 'src/api'] WHEN '' THEN ['.'] ELSE [] END) AS module FROM p UNION SELECT path, o_orderkey, 'tools' FROM p WHERE path IN ('lib/1.py', 'lib/2.py', 'src/3.py'))
SELECT module, count(*) AS findings FROM m GROUP BY 1""")
def findings_by_module(t):
    folder = F.element_at(F.array(*map(F.lit, ["src/", "src/api/", "lib/", ""])), (F.col("o_orderkey") % 4).cast("int") + 1)
    rows = t("orders").select("o_orderkey", F.concat(folder, F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"))
    spark = rows.sparkSession
    modules = spark.createDataFrame([("src",), ("src/api",), (".",), ("none",)], "module string")
    members = spark.createDataFrame([("tools", "lib/1.py"), ("tools", "lib/2.py"), ("tools", "src/3.py")], "module string, path string")
    return findings.in_modules(rows, modules, members).groupBy("module").agg(F.count("*").alias("findings"))


@query(f"""WITH {SQL_FINDINGS}, s AS (SELECT n_name AS module, count(*) AS files, sum(length(s_name))::BIGINT AS loc, sum(s_suppkey)::BIGINT AS sloc FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
lg AS (SELECT n_name AS module, ['go', 'java', 'python'][s_suppkey % 3 + 1] AS lang, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), c AS (SELECT module, arg_min(lang, (-n, lang)) AS language FROM lg GROUP BY 1),
u AS (SELECT n_name AS module, count(*) AS functions, round(avg(c_custkey % 10), 1) AS mean_complexity FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
m AS (SELECT n_name AS module, round(avg(s_acctbal) FILTER (s_suppkey % 2 = 0), 1) AS coverage, round(sum(s_acctbal) FILTER (s_suppkey % 2 = 1), 1) AS churn, NULL::DOUBLE AS duplication FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
z AS (SELECT module, count(*) AS findings, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM h GROUP BY 1)
SELECT module, files, loc, sloc, coalesce(functions, 0) AS functions, coalesce(mean_complexity, 0.0) AS mean_complexity, coverage, churn, duplication, language, coalesce(findings, 0) AS findings, coalesce(score, 100.0) AS score,
CASE WHEN coalesce(score, 100) >= 85 THEN 'good' WHEN score >= 70 THEN 'medium' WHEN score >= 50 THEN 'high' ELSE 'critical' END AS risk FROM s LEFT JOIN c USING (module) LEFT JOIN u USING (module) LEFT JOIN m USING (module) LEFT JOIN z USING (module)""")
def module_rollup(t):
    """Suppliers as files, customers as functions, orders as findings, balances as metrics."""
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lang = F.element_at(F.array(*map(F.lit, ["go", "java", "python"])), (F.col("s_suppkey") % 3).cast("int") + 1)
    files = suppliers.select(F.col("n_name").alias("module"), F.col("s_name").alias("path"), lang.alias("lang"), F.length("s_name").alias("loc"), F.col("s_suppkey").alias("sloc"))
    functions = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("module"), (F.col("c_custkey") % 10).alias("complexity"))
    metrics = suppliers.select(F.col("n_name").alias("module"), F.when(F.col("s_suppkey") % 2 == 0, "line_coverage").otherwise("churn_score").alias("name"), F.col("s_acctbal").alias("value"))
    return findings.module_rollup(files, functions, findings_of(t), metrics)


_HINTED = [("package.json", "javascript", '{"dependencies": {"react": "1"}}'), ("pyproject.toml", "config", "[project]\ndependencies = ['flask']"), ("app.py", "python", "from flask import Flask"), ("test_app.py", "python", "import pytest"), ("go.mod", "go", "module x")]
_HINTS = [("build", "npm", "package.json", None, 5), ("framework", "react", "package.json", '"react"', 3), ("framework", "flask", None, "\\bflask\\b", 2), ("framework", "flask", "app.py", "Flask", 1), ("test", "pytest", None, "import pytest", 4), ("build", "maven", "pom.xml", None, 5)]


@query("SELECT 'build' AS kind, 'npm' AS name, 5::BIGINT AS score UNION ALL SELECT 'framework', 'react', 3 UNION ALL SELECT 'framework', 'flask', 3 UNION ALL SELECT 'test', 'pytest', 4")
def detected_tools(t):
    hints = t("region").sparkSession.createDataFrame(_HINTS, "kind string, name string, file string, pattern string, weight long")
    return findings.detected(projects_of(t, _HINTED), hints)


@query(f"WITH {SQL_LINES_TABLE}, h AS (SELECT doc_id, line_no, 'LICENSE' AS rule_id, 'two' AS engine FROM l WHERE contains(line, 'License') UNION ALL SELECT doc_id, line_no, 'MARKUP', 'one' FROM l WHERE contains(line, '###') UNION ALL SELECT doc_id, line_no, 'TABLE', 'three' FROM l WHERE contains(line, ' | ')) SELECT doc_id, line_no::INT AS line_no, rule_id, engine, CASE engine WHEN 'one' THEN 0 WHEN 'two' THEN 1 ELSE 2 END AS engine_place FROM h QUALIFY rule_id = 'TABLE' OR row_number() OVER (PARTITION BY rule_id ORDER BY doc_id, line_no) <= CASE rule_id WHEN 'LICENSE' THEN 2 ELSE 5 END")
def engines_in_order(t):
    """Findings of three engines as one table, two of the rules capped."""
    lines = lines_of(t)
    of = lambda part, rule: lines.where(F.contains("line", F.lit(part))).select("doc_id", "line_no", F.lit(rule).alias("rule_id"))
    every = findings.in_engine_order({"two": of("License", "LICENSE"), "one": of("###", "MARKUP"), "three": of(" | ", "TABLE")}, ["one", "two"])
    return findings.capped(every, {"LICENSE": 2, "MARKUP": 5}, ["doc_id", "line_no"])


@query(f"WITH {SQL_EDGES}, k AS (SELECT caller, count(*) AS many FROM e WHERE caller <> callee GROUP BY 1) SELECT caller AS node, 'public' AS entry FROM k WHERE many >= 2 AND caller NOT IN (SELECT callee FROM e WHERE confidence >= 0.95 AND caller <> callee)")
def entry_nodes(t):
    """Nations that several edges leave and that no sure one enters."""
    edges = edges_of(t).where("caller <> callee")
    fan = edges.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("n")).where("n >= 2")
    return graph.entry_points(edges, 0.95).join(fan, "node", "left_semi").withColumn("entry", F.lit("public"))

