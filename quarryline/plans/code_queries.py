"""Source code on the driver's tables: each row of a table stands for a file or project with one of a few texts.

The SQL states what has to be found in these texts, by rule, place and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import code, design, findings, graph, line_rules, project_rules, summaries
from quarryline.operators.lines import explode_lines
from quarryline.plans.code_fixtures import FIXTURES
from quarryline.plans.core_queries import SQL_EDGES, edges_of
from quarryline.plans.flow_fixtures import CROSS, FILES, FLOWS
from quarryline.session import materialize
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


def values(rows: list[tuple]) -> str:
    """Rows as SQL."""
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Keys of a table, dealt to all cores: a table of few bytes is read by one task, however much work its rows make."""
    return rows.select(key).repartition(max(48, 3 * rows.sparkSession.sparkContext.defaultParallelism), key)


def files_of(t, texts: list[tuple[str, str, str]], name: str, key: str) -> DataFrame:
    """``path, lang, content``: the row of a table whose key is k has the text of number k modulo their count."""
    rows = dealt(t(name), key)
    known = rows.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(texts)], "n long, name string, lang string, content string")
    return rows.select(F.col(key).cast("string").alias("dir"), F.pmod(F.col(key), F.lit(len(texts))).alias("n")).join(F.broadcast(known), "n").select(F.concat_ws("/", "dir", "name").alias("path"), "lang", "content")


#: Blank lines at the head of each text of a supplier's project, which move all that is found in it.
SQL_LEAD = "s_suppkey % 4"


def projects_of(t, texts: list[tuple[str, str, str]]) -> DataFrame:
    """``path, lang, content``: every supplier has a project with all the texts, each moved down by as many blank lines as its key says."""
    all_ = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lang).alias("lang"), F.lit(c).alias("content")) for n, lang, c in texts])
    each = dealt(t("supplier"), "s_suppkey").select(F.col("s_suppkey").cast("string").alias("dir"), F.expr(f"repeat('\\n', cast({SQL_LEAD} as int))").alias("lead"), F.explode(all_).alias("f"))
    return each.select(F.concat_ws("/", "dir", "f.name").alias("path"), "f.lang", F.concat("lead", "f.content").alias("content"))


def lines_in(files: DataFrame) -> DataFrame:
    return explode_lines(files, ["path", "lang"], "content")


_TEXTS = [(f"{i}.{kind}", lang, text) for i, (_, lang, bad, _, good) in enumerate(FIXTURES) for kind, text in (("flagged", bad), ("clean", good))]
# What else the texts have besides the rule that each is about: text, whether it is the clean one, rule, line.
_BESIDES = [
    (29, True, "POSSIBLE-NONE-DEREF", 3),
    (35, True, "POSSIBLE-NONE-DEREF", 3),
    (57, False, "EXCEPTION-SWALLOWED-NO-LOG", 4),
    (72, True, "RECURSION-NO-BOUNDARY-GUARD", 4),
    (120, False, "DIVISION-BY-ZERO-RISK", 3),
    (197, False, "RESOURCE-LEAK", 2),
    (201, False, "EMPTY-LOOP-BODY", 2),
    (203, True, "EXCEPTION-SWALLOWED-NO-LOG", 4),
    (203, False, "EXCEPTION-SWALLOWED-NO-LOG", 4),
    (204, True, "BATCH-FAILURE-SWALLOWED", 2),
    (204, False, "BATCH-FAILURE-SWALLOWED", 2),
    (220, True, "ASSERT-USED", 3),
]
_EXPECTED = values([(2 * i, f"{i}.flagged", rule, line) for i, (rule, _, _, line, _) in enumerate(FIXTURES)] + [(2 * i + clean, f"{i}.{'clean' if clean else 'flagged'}", rule, line) for i, clean, rule, line in _BESIDES])


@query(f"SELECT p_partkey || '/' || name AS path, rule_id, line::INT AS line_no FROM part JOIN {_EXPECTED} e(n, name, rule_id, line) ON p_partkey % {len(_TEXTS)} = e.n")
def code_rule_hits(t):
    """Hits of all rules in texts that each have one, and in their clean counterparts."""
    files = files_of(t, _TEXTS, "part", "p_partkey")
    return line_rules.line_hits(lines_in(files)).unionByName(code.syntax_hits(files)).select("path", "rule_id", "line_no").distinct()


def _program(t):
    files = projects_of(t, FILES)
    found = materialize(summaries.functions(files), "functions")
    edges = materialize(summaries.call_edges(found), "calls")
    own = materialize(summaries.summaries(found), "own-summaries")  # read several times
    return found, edges, materialize(summaries.propagated(own, edges), "summaries")


@query(f"SELECT rule_id, s_suppkey || '/' || node AS node, (line + {SQL_LEAD})::INT AS line_no FROM supplier, {values(CROSS)} e(rule_id, node, line)")
def cross_function_rules(t):
    found, edges, summary = _program(t)
    return summaries.cross_function_hits(summary, edges, found).select("rule_id", "node", "line_no").distinct()


@query(f"SELECT rule_id, s_suppkey || '/' || node AS node, (line + {SQL_LEAD})::INT AS line_no FROM supplier, {values(FLOWS)} e(rule_id, node, line)")
def business_flow_rules(t):
    found, edges, summary = _program(t)
    flows = summaries.processes(summary, edges)
    return summaries.process_hits(flows, summaries.process_facts(flows, summary), summary, edges, found)


# Function: may be null, has a null result, throws, throws or calls what does, releases, is entered by, types that escape, untrusted result, held result.
_FLAGS = [
    ("app.py::find_user", True, True, False, False, False, None, "", False, False),
    ("app.py::load_user", False, True, False, False, False, None, "", False, False),
    ("app.py::greet", False, False, False, False, False, None, "", False, False),
    ("app.py::greet_checked", False, False, False, False, False, None, "", False, False),
    ("app.py::open_log", False, False, False, False, False, None, "", False, True),
    ("app.py::use_log", False, False, False, False, False, None, "", False, False),
    ("app.py::parse", False, False, True, True, False, None, "ValueError", False, False),
    ("app.py::read_all", False, False, False, True, True, None, "ValueError", False, False),
    ("app.py::guarded", False, False, False, True, False, None, "ValueError", False, False),
    ("app.py::search", False, False, False, False, False, None, "", True, False),
    ("app.py::run_search", False, False, False, False, False, None, "", False, False),
    ("app.py::query_rows", False, False, False, False, False, None, "", False, False),
    ("app.py::search_safely", False, False, False, False, False, None, "", False, False),
    ("app.py::check", False, False, False, False, False, "http", "TypeError", False, False),
    ("app.py::step_one", False, False, False, True, False, None, "TypeError", False, False),
    ("app.py::strict", False, False, True, True, False, None, "TypeError", False, False),
    ("app.py::hold", False, False, False, True, True, None, "ValueError", False, False),
    ("app.py::Shop.create_order", False, False, False, False, False, "http", "", False, False),
    ("app.py::Shop.keep", False, False, False, False, False, None, "", False, False),
    ("app.py::Shop.keep_lines", False, False, False, False, False, None, "", False, False),
    ("app.py::Shop.notify", False, False, False, False, False, None, "", False, False),
    ("app.py::Shop.charge", False, False, False, False, False, None, "", False, False),
    ("app.py::Shop.after", False, False, False, False, False, None, "", False, False),
    ("app.py::Shop.last", False, False, False, False, False, None, "", False, False),
    ("app.py::show", False, False, False, False, False, None, "", False, False),
    ("svc.go::store", False, False, False, False, False, None, "", False, False),
    ("svc.go::write", False, False, False, False, False, None, "", False, False),
    ("svc.go::Run", False, False, False, False, False, None, "", False, False),
    ("svc.go::RunChecked", False, False, False, False, False, None, "", False, False),
]
_FLAG_NAMES = ["may_null", "null_result", "throws", "throw_result", "releases", "entry", "escapes", "taint_result", "held_result"]
_FLAG_SQL = ", ".join(n if n in ("entry", "escapes") else f"{n}::BOOLEAN AS {n}" for n in _FLAG_NAMES)


@query(f"SELECT s_suppkey || '/' || node AS node, {_FLAG_SQL} FROM supplier, {values([tuple(int(x) if isinstance(x, bool) else x for x in r) for r in _FLAGS])} e(node, {', '.join(_FLAG_NAMES)})")
def function_summaries(t):
    """Own and propagated facts of all functions of a small program, one a supplier."""
    _, _, summary = _program(t)
    return summary.withColumn("escapes", F.array_join("escapes", ",")).select("node", *_FLAG_NAMES)


_CALLS = [
    ("app.py::Shop.after", "app.py::Shop.last", 99, 0.95),
    ("app.py::Shop.charge", "app.py::show", 94, 0.95),
    ("app.py::Shop.charge", "app.py::Shop.after", 96, 0.95),
    ("app.py::Shop.create_order", "app.py::Shop.keep", 73, 0.95),
    ("app.py::Shop.create_order", "app.py::Shop.keep_lines", 74, 0.95),
    ("app.py::Shop.create_order", "app.py::Shop.notify", 75, 0.95),
    ("app.py::Shop.notify", "app.py::Shop.charge", 89, 0.95),
    ("app.py::check", "app.py::step_one", 57, 0.95),
    ("app.py::greet", "app.py::load_user", 10, 0.95),
    ("app.py::greet_checked", "app.py::load_user", 14, 0.95),
    ("app.py::guarded", "app.py::parse", 39, 0.95),
    ("app.py::hold", "app.py::parse", 67, 0.95),
    ("app.py::load_user", "app.py::find_user", 7, 0.95),
    ("app.py::open_log", "app.py::use_log", 21, 0.95),
    ("app.py::read_all", "app.py::parse", 33, 0.95),
    ("app.py::run_search", "app.py::query_rows", 46, 0.95),
    ("app.py::search", "app.py::run_search", 43, 0.95),
    ("app.py::search_safely", "app.py::run_search", 53, 0.95),
    ("app.py::step_one", "app.py::strict", 60, 0.95),
    ("svc.go::Run", "svc.go::store", 12, 0.95),
    ("svc.go::RunChecked", "svc.go::store", 16, 0.95),
    ("svc.go::store", "svc.go::write", 4, 0.95),
]


@query(f"SELECT s_suppkey || '/' || caller AS caller, s_suppkey || '/' || callee AS callee, (line + {SQL_LEAD})::INT AS line_no, confidence::DOUBLE AS confidence FROM supplier, {values(_CALLS)} e(caller, callee, line, confidence)")
def call_edges(t):
    """All calls between the functions of a small program, one a supplier."""
    _, edges, _ = _program(t)
    return edges.select("caller", "callee", "line_no", "confidence")


@query("SELECT s_suppkey || '/app.py::Shop.create_order' AS origin, 'http' AS entry, 8::BIGINT AS functions, 4 AS max_depth, 2::BIGINT AS writes, 3::BIGINT AS remote_calls, 1::BIGINT AS raced FROM supplier UNION ALL SELECT s_suppkey || '/app.py::check', 'http', 3, 2, 0, 0, 0 FROM supplier")
def process_properties(t):
    _, edges, summary = _program(t)
    facts = summaries.process_facts(summaries.processes(summary, edges), summary)
    return facts.select("origin", "entry", "functions", "max_depth", "writes", "remote_calls", "raced")


_TANGLED = """\
class Job:
    def run(self, rows, flag):
        for row in rows:
            if row and flag:
                try:
                    self.one(row)
                except OSError:
                    raise
            elif [x for x in row if x]:
                pass
        return 1 if flag else 2

    async def one(self, row):
        return row
"""
_SHAPES = """\
interface Shape { double area(); }
class Square implements Shape {
  private double side;
  public double area() {
    if (side > 0 && side < 9) { return side * side; }
    return 0;
  }
  static Square of(double a, int b) {
    for (int i = 0; i < b; i++) {
      while (a > 1) { a = a / 2; }
    }
    return new Square();
  }
}
"""
# kind, name, owner, first and last line, parameters, complexity, nesting, cognitive complexity
_BLOCKS = [
    ("job.py", "class", "Job", "", 1, 14, 0, 0, 0, 0),
    ("job.py", "function", "run", "Job", 2, 11, 3, 9, 3, 21),
    ("job.py", "function", "one", "Job", 13, 14, 2, 1, 0, 0),
    ("Shapes.java", "class", "Shape", "", 1, 1, 0, 0, 0, 0),
    ("Shapes.java", "class", "Square", "", 2, 14, 0, 0, 0, 0),
    ("Shapes.java", "function", "area", "Square", 4, 7, 0, 3, 1, 3),
    ("Shapes.java", "function", "of", "Square", 8, 13, 2, 3, 2, 3),
]
_SOURCES = [("job.py", "python", _TANGLED), ("Shapes.java", "java", _SHAPES)]


@query(f"SELECT s_suppkey || '/' || file AS path, kind, name, owner, (a + {SQL_LEAD})::INT AS start_line, (z + {SQL_LEAD})::INT AS end_line, p::INT AS params, c::INT AS complexity, n::INT AS nesting, g::INT AS cognitive FROM supplier, {values(_BLOCKS)} e(file, kind, name, owner, a, z, p, c, n, g)")
def code_blocks(t):
    return code.blocks(projects_of(t, _SOURCES)).select("path", "kind", "name", "owner", "start_line", "end_line", "params", "complexity", "nesting", "cognitive")


_FUNCTIONS = [b for b in _BLOCKS if b[1] == "function"]


@query(f"SELECT count(*) AS functions, round(avg(c), 2) AS mean_complexity, max(c)::INT AS max_complexity, round(avg(g), 2) AS mean_cognitive, max(n)::INT AS max_nesting, max(p)::INT AS max_params FROM supplier, {values(_FUNCTIONS)} e(file, kind, name, owner, a, z, p, c, n, g)")
def complexity_metrics(t):
    return design.complexity_metrics(code.blocks(projects_of(t, _SOURCES)))


def _god(lines: int, methods: int) -> str:
    body = "".join(f"  void m{i}() {{\n{'    go();' + chr(10) if i % 2 else ''}  }}\n" for i in range(methods))
    return "class Everything {\n" + body + "  // more\n" * (lines - 2 - body.count("\n")) + "}\n"


_DESIGN = [
    ("God.java", "java", _god(520, 21)),
    ("Small.java", "java", _god(519, 19)),
    ("Data.java", "java", "class Data {\n  private int a;\n  private int b;\n  private int c;\n  int getA() { return a; }\n  void setA(int x) { a = x; }\n}\n"),
    ("Wide.java", "java", "interface Wide {\n" + "".join(f"  void part{i}(int x);\n" for i in range(11)) + "}\n"),
    ("Maker.java", "java", "class Maker {\n  void all() {\n" + "".join(f"    use(new Thing{c}());\n" for c in "ABCDEF") + "  }\n}\n"),
    ("deep.py", "python", "class A: ...\n" + "".join(f"class {b}({a}): ...\n" for a, b in zip("ABCDEF", "BCDEFG", strict=True))),
    ("coupled.py", "python", "class Hub:\n    def go(self):\n" + "".join(f"        Part{c}a.run()\n" for c in "ABCDEFGHIJKLMNOP")),
]
_DESIGNED = [("God.java", "GOD-CLASS", 1, 520), ("Data.java", "DATA-CLASS", 1, 7), ("Wide.java", "ISP-VIOLATION", 1, 13), ("Maker.java", "DIP-VIOLATION", 1, 10), ("deep.py", "DEEP-INHERITANCE", 7, 7), ("coupled.py", "HIGH-CLASS-COUPLING", 1, 18)]


@query(f"SELECT s_suppkey || '/' || file AS path, rule_id, (a + {SQL_LEAD})::INT AS line_no, (z + {SQL_LEAD})::INT AS line_end FROM supplier, {values(_DESIGNED)} e(file, rule_id, a, z)")
def design_rules(t):
    return design.class_hits(design.classes(projects_of(t, _DESIGN)))


@query("SELECT s_suppkey || '/deep.py' AS path, name, depth::INT AS depth FROM supplier, (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4), ('F', 5), ('G', 6)) e(name, depth)")
def inheritance_depth(t):
    files = projects_of(t, _DESIGN).where(F.col("path").endswith("/deep.py"))  # before the parse, which a filter does not pass
    return design.classes(files).select("path", "name", "depth")


def _branchy(name: str, branches: int, lines: int, params: int = 0) -> str:
    body = "".join(f"    if x{i}: go()\n" for i in range(branches))
    return f"def {name}({', '.join(f'p{i}' for i in range(params))}):\n" + body + "    go()\n" * (lines - 1 - branches)


_LONG = [
    ("cc.py", "python", _branchy("f", 14, 20)),
    ("very.py", "python", _branchy("f", 24, 30)),
    ("long.py", "python", _branchy("f", 2, 60)),
    ("longer.py", "python", _branchy("f", 2, 120)),
    ("deep.py", "python", "def f():\n" + "".join("    " * (i + 1) + "while x:\n" for i in range(5)) + "    " * 6 + "go()\n"),
    ("many.py", "python", _branchy("f", 0, 5, 6)),
    ("plain.py", "python", _branchy("f", 13, 20, 5)),
]
_LARGE = [("cc.py", "HIGH-CC-FUNCTION", "low", 20), ("very.py", "HIGH-CC-FUNCTION", "medium", 30), ("long.py", "LONG-FUNCTION", "low", 60), ("longer.py", "LONG-FUNCTION", "medium", 120), ("deep.py", "DEEP-NESTING", "low", 7), ("many.py", "TOO-MANY-PARAMS", "low", 5)]


@query(f"SELECT s_suppkey || '/' || file AS path, 'f' AS name, rule_id, severity, (1 + {SQL_LEAD})::INT AS line_no, (z + {SQL_LEAD})::INT AS line_end FROM supplier, {values(_LARGE)} e(file, rule_id, severity, z)")
def function_findings(t):
    return design.function_findings(code.blocks(projects_of(t, _LONG)))


_BUILD = [("Dockerfile", "docker", "FROM python:3.13\nRUN x\n"), ("ok.Dockerfile", "docker", "FROM python:3.13\nUSER root\nRUN x\nUSER app\n"), ("root.Dockerfile", "docker", "FROM a:1\nUSER app\nUSER root\n"), (".env", "config", "A=1"), (".env.example", "config", "A="), (".env.local", "config", "A=1")]


@query("SELECT rule_id, s_suppkey || '/' || file AS path, 1 AS line_no FROM supplier, (VALUES ('DOCKERFILE-ROOT-USER', 'Dockerfile'), ('DOCKERFILE-ROOT-USER', 'root.Dockerfile'), ('ENV-FILE-TRACKED', '.env')) e(rule_id, file)")
def build_file_rules(t):
    return project_rules.build_file_findings(projects_of(t, _BUILD), F.col("path").endswith(".local"))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(floor(o_totalprice / 50000)) AS v FROM orders GROUP BY 1, 2),
h AS (SELECT o_custkey::VARCHAR AS path, sum(v) AS changed, sum(n) AS commits, round(max(n) / sum(n), 3) AS top_share FROM a GROUP BY 1),
s AS (SELECT * FROM h WHERE commits >= 3 OR changed >= 20 ORDER BY changed DESC, commits DESC, path LIMIT 10), w AS (SELECT * FROM h WHERE commits >= 3 AND top_share >= 0.8 ORDER BY top_share DESC, changed DESC, path LIMIT 10)
SELECT 'GIT-HOTSPOT' AS rule_id, path, CASE WHEN changed >= 60 OR commits >= 5 THEN 'high' ELSE 'medium' END AS severity, changed::DOUBLE AS value FROM s
UNION ALL SELECT 'OWNERSHIP-RISK', path, CASE WHEN top_share >= 0.95 AND commits >= 5 THEN 'high' ELSE 'medium' END, top_share FROM w""")
def history_findings(t):
    """Customers as files, orders as commits, priorities as authors."""
    by = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("o_totalprice") / 50000)).alias("v"))
    files = by.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.sum("v").alias("changed"), F.sum("n").alias("commits"), F.round(F.max("n") / F.sum("n"), 3).alias("top_share"))
    return project_rules.history_findings(files)


@query("""WITH f AS (SELECT CASE WHEN l_suppkey % 7 = 0 THEN 'tests/' ELSE 'src/' END || l_suppkey AS path, sum((l_linestatus = 'F')::INT) AS covered, count(*) AS total FROM lineitem WHERE l_suppkey % 5 > 0 OR l_linestatus <> 'F' GROUP BY 1),
p AS (SELECT round(100.0 * sum(covered) / sum(total), 1) AS percent FROM f), c AS (SELECT round(100.0 * sum((l_linestatus = 'F')::INT) / count(*), 1) AS percent FROM lineitem WHERE l_returnflag = 'N'),
w AS (SELECT path, round(100.0 * covered / total, 1) AS percent, total FROM f WHERE path NOT LIKE 'tests/%' AND round(100.0 * covered / total, 1) < 60 ORDER BY 2, total DESC, path LIMIT 10)
SELECT 'LOW-PROJECT-COVERAGE' AS rule_id, 'project' AS path, CASE WHEN percent < 60 THEN 'high' ELSE 'medium' END AS severity, percent AS value FROM p WHERE percent < 80
UNION ALL SELECT 'LOW-FILE-COVERAGE', path, CASE WHEN percent < 20 THEN 'high' ELSE 'medium' END, percent FROM w
UNION ALL SELECT 'LOW-CHANGE-COVERAGE', 'project', CASE WHEN percent < 60 THEN 'high' ELSE 'medium' END, percent FROM c WHERE percent < 80""")
def coverage_findings(t):
    """Suppliers as files, shipped lines as covered ones; lines that may not be returned are the changed ones."""
    lines, hit = t("lineitem"), (F.col("l_linestatus") == "F").cast("int")
    path = F.concat(F.when(F.col("l_suppkey") % 7 == 0, "tests/").otherwise("src/"), F.col("l_suppkey").cast("string"))
    files = lines.where("l_suppkey % 5 > 0 or l_linestatus <> 'F'").groupBy(path.alias("path")).agg(F.sum(hit).alias("covered"), F.count("*").alias("total"))
    changed = lines.where("l_returnflag = 'N'").agg(F.round(100.0 * F.sum(hit) / F.count("*"), 1).alias("percent"))
    return project_rules.coverage_findings(files, findings.is_test_path(F.col("path")), changed)


@query(f"""WITH RECURSIVE {SQL_EDGES}, d AS (SELECT DISTINCT caller AS s, callee AS t FROM e WHERE caller <> callee),
r(o, n, h) AS (SELECT s, t, 1 FROM d UNION SELECT o, t, h + 1 FROM r JOIN d ON n = s WHERE h < 4), c AS (SELECT o, min(h) AS h FROM r WHERE o = n GROUP BY 1),
f AS (SELECT coalesce(a.s, b.t) AS x, coalesce(fo, 0) AS fo, coalesce(fi, 0) AS fi FROM (SELECT s, count(*) AS fo FROM d GROUP BY 1) a FULL JOIN (SELECT t, count(*) AS fi FROM d GROUP BY 1) b ON a.s = b.t),
i AS (SELECT x, fo, round(fo / (fo + fi), 3) AS i FROM f), u AS (SELECT s, count(*) AS n FROM d JOIN i a ON a.x = s JOIN i b ON b.x = t WHERE a.i < 0.3 AND b.i > 0.8 GROUP BY 1)
SELECT 'CIRCULAR-DEPENDENCY' AS rule_id, o AS path, 'high' AS severity, h::DOUBLE AS value FROM c UNION ALL SELECT 'HIGH-FAN-OUT', x, 'medium', fo::DOUBLE FROM i WHERE fo > 15 UNION ALL SELECT 'UNSTABLE-DEPENDENCY', s, 'medium', n::DOUBLE FROM u""")
def dependency_rules(t):
    return project_rules.dependency_findings(edges_of(t).select(F.col("caller").alias("source"), F.col("callee").alias("target")), depth=4)


@query(f"""WITH RECURSIVE {SQL_EDGES}, d AS (SELECT DISTINCT caller, callee FROM e WHERE caller <> callee), r(node, hops) AS (SELECT caller, 1 FROM d WHERE callee = 8 UNION SELECT caller, hops + 1 FROM r JOIN d ON callee = node WHERE hops < 2)
SELECT 8 AS origin, node, min(hops) AS hops FROM r WHERE node <> 8 GROUP BY node""")
def reach_back(t):
    """What leads to one node within two hops."""
    edges = edges_of(t)
    start = edges.select(F.col("callee").alias("node")).where("node = 8").distinct()
    return graph.reach(edges, 2, start, forward=False)


@query(f"""WITH RECURSIVE {SQL_EDGES}, p(nodes, hops, c) AS (SELECT [caller, callee], 1, confidence FROM e WHERE caller = 8 AND caller <> callee
UNION ALL SELECT list_append(nodes, callee), hops + 1, least(c, confidence) FROM p JOIN e ON caller = nodes[-1] WHERE hops < 3 AND nodes[-1] <> 20 AND NOT list_contains(nodes, callee)),
q AS (SELECT array_to_string(nodes, '>') AS path, hops, c AS confidence FROM p WHERE nodes[-1] = 20) SELECT path, hops, confidence FROM q ORDER BY confidence DESC, hops, path LIMIT 20""")
def paths_to_sink(t):
    return graph.simple_paths(edges_of(t), 8, 3, sink=20, most=20)


@query(f"""WITH {SQL_EDGES}, k AS (SELECT caller, callee, confidence FROM e WHERE confidence >= 0.5), v AS (SELECT 3 AS node, 0 AS hops UNION ALL SELECT DISTINCT callee, 1 FROM k WHERE caller = 3 AND callee <> 3)
SELECT 3 AS origin, hops + 1 AS hop, caller, callee, confidence FROM v JOIN k ON caller = node""")
def two_hop_edges(t):
    edges = edges_of(t).select("caller", "callee", "confidence")
    start = edges.select(F.col("caller").alias("node")).where("node = 3").distinct()
    return graph.hop_edges(edges, start, 2).select("origin", "hop", "caller", "callee", "confidence")
