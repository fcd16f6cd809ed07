"""A model's review on the driver's tables: turns of conversations stand for its findings, parts for pieces of code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import code, review, summaries
from quarryline.plans.code_queries import SQL_LEAD, _program, files_of, projects_of, values
from quarryline.plans.core_queries import SQL_LINES_TABLE, lines_of
from quarryline.plans.flow_fixtures import FILES
from quarryline.sources import files as source_files
from quarryline.sources import findings as source_findings
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


_KINDS = ["security", "logic", "style", "null_safety", "resource", "Performance"]
_GRADES = ["critical", "high", "medium", "low", "odd"]


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


SQL_ROWS = f"""t AS (SELECT conv_id * 100 + turn AS id, conv_id % 7 AS path, (turn * 3 + conv_id % 5)::INT AS line_no, {_list(_KINDS)}[(conv_id + turn) % 6 + 1] AS category, {_list(_GRADES)}[(conv_id + 2 * turn) % 5 + 1] AS severity, ((conv_id * 3 + turn) % 11)::INT AS confidence,
  CASE WHEN turn % 2 = 0 THEN 'x.get(1).y' ELSE substr(text, 1, 9) END AS evidence, role FROM conversations)"""


def rows_of(t) -> DataFrame:
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (key % len(names)).cast("int") + 1)
    c, n = F.col("conv_id"), F.col("turn")
    return t("conversations").select(
        (c * 100 + n).alias("id"),
        (c % 7).alias("path"),
        (n * 3 + c % 5).cast("int").alias("line_no"),
        pick(_KINDS, c + n).alias("category"),
        pick(_GRADES, c + 2 * n).alias("severity"),
        ((c * 3 + n) % 11).cast("int").alias("confidence"),
        F.when(n % 2 == 0, "x.get(1).y").otherwise(F.substring("text", 1, 9)).alias("evidence"),
        "role",
    )


@query(f"""WITH {SQL_ROWS}, k AS (SELECT p_partkey % 7 AS path, (10 + p_partkey % 3)::INT AS line_no FROM part WHERE p_size > 40 AND p_partkey % 7 < 5), d AS (SELECT DISTINCT path, line_no FROM k),
g AS (SELECT t.*, (SELECT arg_min(d.line_no, (d.line_no <> t.line_no, d.line_no)) FROM d WHERE d.path = t.path AND abs(d.line_no - t.line_no) <= 3) AS match FROM t WHERE lower(category) <> 'style' AND confidence >= 3)
SELECT id, CASE WHEN match IS NOT NULL THEN 'local' WHEN confidence >= 6 THEN 'primary' ELSE 'supplementary' END AS tier, match, CASE lower(category) WHEN 'security' THEN 'security' WHEN 'resource' THEN 'performance' WHEN 'performance' THEN 'performance' ELSE 'defect' END AS category,
CASE WHEN lower(category) = 'null_safety' AND severity IN ('critical', 'high') AND evidence <> 'x.get(1).y' THEN 'medium' WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity = 'low' THEN 'low' ELSE 'medium' END AS severity,
CASE WHEN match IS NOT NULL THEN 'high' WHEN confidence >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def merge_tiers(t):
    known = t("part").where("p_size > 40 and p_partkey % 7 < 5").select((F.col("p_partkey") % 7).alias("path"), (10 + F.col("p_partkey") % 3).cast("int").alias("line_no"))
    return review.merge_tiers(rows_of(t), known)


@query(f"""WITH {SQL_ROWS}, s AS (SELECT *, 10 * CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END + least(10, greatest(1, confidence)) + CASE WHEN category IN ('security', 'logic', 'error_handling') THEN 4 ELSE 0 END AS points
  FROM t WHERE confidence >= 3 QUALIFY row_number() OVER (PARTITION BY path, line_no, category ORDER BY id) = 1) SELECT id, points::INT AS points FROM s ORDER BY points DESC, id LIMIT 100""")
def suspicion_queue(t):
    rows = rows_of(t).select("id", "path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("category").alias("title"), "category", "severity", "confidence")
    return review.suspicions(rows, "id", top=100).select("id", "points")


SQL_VERDICTS = f"""{SQL_ROWS}, f AS (SELECT id, severity, ['BROAD-EXCEPT', 'WEAK-HASH'][id % 2 + 1] AS rule_id FROM t),
v AS (SELECT id, severity, rule_id, CASE WHEN id % 13 = 0 THEN 'ai-verified-true' END AS kept, CASE WHEN id % 5 > 0 THEN ['ai-verified-true', 'ai-verified-fp', 'ai-uncertain'][id % 3 + 1] END AS one, CASE WHEN id % 4 = 0 THEN ['ai-verified-fp', 'ai-uncertain'][id % 2 + 1] END AS two FROM f),
a AS (SELECT *, severity IN ('critical', 'high') OR rule_id = 'BROAD-EXCEPT' OR one = 'ai-uncertain' AS again FROM v),
z AS (SELECT id, severity, CASE WHEN kept IS NOT NULL THEN kept WHEN one IS NULL THEN 'ai-skipped' WHEN again AND two IS NOT NULL THEN two ELSE one END AS status, CASE WHEN kept IS NOT NULL THEN 0 WHEN one IS NULL THEN NULL WHEN again AND two IS NOT NULL THEN 2 ELSE 1 END AS passed FROM a)"""


def _verdicts(t) -> tuple[DataFrame, DataFrame]:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int") + 1)
    found = rows_of(t).select("id", "severity", pick(["BROAD-EXCEPT", "WEAK-HASH"]).alias("rule_id"))
    said = lambda where, names: found.where(where).select("id", pick(names).alias("status"))
    out = review.final_verdicts(found, said("id % 13 = 0", ["ai-verified-true"]), said("id % 5 > 0", ["ai-verified-true", "ai-verified-fp", "ai-uncertain"]), said("id % 4 = 0", ["ai-verified-fp", "ai-uncertain"]))
    return found, out


@query(f"WITH {SQL_VERDICTS} SELECT id, status, passed::INT AS passed FROM z")
def final_verdicts(t):
    return _verdicts(t)[1]


@query(f"WITH {SQL_VERDICTS} SELECT sum((status = 'ai-verified-true')::INT)::BIGINT AS confirmed, sum((status = 'ai-verified-fp')::INT)::BIGINT AS refused, sum((status = 'ai-uncertain')::INT)::BIGINT AS unsure, sum((status = 'ai-skipped')::INT)::BIGINT AS skipped FROM z")
def verdict_tally(t):
    return review.tally(_verdicts(t)[1])


@query(f"""WITH {SQL_VERDICTS} SELECT id, CASE WHEN status = 'ai-verified-fp' THEN 'info' ELSE severity END AS severity, id % 9 = 0 AND status <> 'ai-verified-fp' AS blocks, CASE status WHEN 'ai-verified-true' THEN 'static-confirmed' WHEN 'ai-verified-fp' THEN 'needs-review' ELSE 'likely' END AS evidence_level,
CASE status WHEN 'ai-verified-true' THEN 'ai-confirmed' WHEN 'ai-verified-fp' THEN 'ai-fp' ELSE status END AS tags FROM z WHERE status <> 'ai-verified-fp' OR id % 2 = 0""")
def applied_verdicts(t):
    """Verdicts applied; of the findings that are false every second is dropped as well."""
    found, verdicts = _verdicts(t)
    rows = found.select("id", "severity", (F.col("id") % 9 == 0).alias("blocks"), F.lit("likely").alias("evidence_level"), F.array().cast("array<string>").alias("tags"))
    out = review.with_verdicts(rows, verdicts)
    return out.where("status <> 'ai-verified-fp' or id % 2 = 0").select("id", "severity", "blocks", "evidence_level", F.array_join("tags", ",").alias("tags"))


@query("""WITH r AS (SELECT event_type, event_id, epoch_us(ts) / 1000000.0 AS came, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, round(max(came - i / 0.002) OVER (PARTITION BY event_type ORDER BY came, event_id) + i / 0.002 - came, 2) AS wait FROM r""")
def paced_requests(t):
    """Events as requests of one limiter a kind, at most one in 500 seconds; how long each waits."""
    rows = t("events").select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("at"))
    return review.paced(rows, "event_type", "at", 0.002).select("event_id", F.round(F.col("start") - F.col("at"), 2).alias("wait"))


@query("""WITH w AS (SELECT DISTINCT user_id, event_type, sha256(event_type || ':' || user_id) AS key FROM events), c AS (SELECT sha256(event_type || ':' || user_id) AS key, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY GROUP BY 1)
SELECT user_id, event_type, event_id FROM w LEFT JOIN c USING (key)""")
def remembered_rows(t):
    events = t("events").withColumn("key", review.chunk_key(F.col("event_type"), F.col("user_id").cast("string")))
    wanted = events.select("user_id", "event_type", "key").distinct()
    return review.remembered(wanted, events.select("key", "event_id", "ts"), "key", "ts", F.lit("2024-01-20").cast("timestamp")).select("user_id", "event_type", "event_id")


@query(f"""WITH {SQL_LINES_TABLE}, h AS (SELECT doc_id, line_no FROM l WHERE contains(line, '###')), n AS (SELECT h.doc_id, h.line_no, l.line_no AS place, line, sum(strlen(line) + 1) OVER (PARTITION BY h.doc_id, h.line_no ORDER BY l.line_no) AS bytes FROM h JOIN l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 5 AND h.line_no + 25)
SELECT doc_id, line_no::INT AS line_no, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM n WHERE bytes <= 400 GROUP BY 1, 2""")
def evidence_windows(t):
    lines = lines_of(t).select("doc_id", "line_no", "line")
    return review.evidence(lines.where(F.contains("line", F.lit("###"))), lines, ["doc_id"], most_bytes=400).select("doc_id", "line_no", F.sha2("text", 256).alias("digest"))


_METHOD = "  int part{i}(int x) {{\n" + "    x += 1;\n" * 60 + "    return x;\n  }}\n"
_BIG = "class Big {\n" + "".join(_METHOD.format(i=i) for i in range(4)) + "}\nclass Little {\n  int one() { return 1; }\n}\n" + "// filler\n" * 60
_PIECES = [("src/Big.java", "java", _BIG), ("src/small.py", "python", "x = 1\ny = 2"), ("vendor/a.py", "python", "x = 1"), ("src/made.go", "go", "// Code generated by x\npackage a"), ("src/blank.py", "python", " \n"), ("src/free.py", "python", "def get_x():\n    return 1\n\n" + "def long(a):\n" + "    a += 1\n" * 300)]
_CHUNKS = [("src/Big.java", "function", f"Big.part{i}", 2 + 63 * i, 64 + 63 * i) for i in range(4)] + [("src/Big.java", "class", "Little", 255, 257), ("src/small.py", "file", "", 1, 2), ("src/free.py", "function", "long", 4, 304)]


@query(f"SELECT s_suppkey || '/' || path AS path, kind, name, (CASE kind WHEN 'file' THEN a ELSE a + {SQL_LEAD} END)::INT AS line_start, (z + {SQL_LEAD})::INT AS line_end FROM supplier, {values(_CHUNKS)} e(path, kind, name, a, z)")
def review_chunks(t):
    files = projects_of(t, _PIECES)
    return review.chunks(files, code.blocks(files)).select("path", "kind", "name", "line_start", "line_end")


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 OR p_partkey % 17 = 0 THEN 0 WHEN p_size >= 15 AND p_size % 2 = 0 OR p_partkey % 8 >= 5 THEN 1 ELSE 2 END AS priority FROM part")
def review_priority(t):
    complexity = F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0)
    return t("part").select("p_partkey", review.chunk_priority(F.col("p_size") % 10 == 0, F.col("p_partkey") % 17 == 0, complexity, F.col("p_partkey") % 8).alias("priority"))


@query("SELECT s_suppkey || '/app.py::Shop.create_order' AS node, 'def keep(self, order):' || chr(10) || 'def keep_lines(self, order):' || chr(10) || 'def notify(self, order):' AS callees, 'R1,R2' AS findings FROM supplier UNION ALL SELECT s_suppkey || '/app.py::greet', 'def load_user(key):', '' FROM supplier")
def review_context(t):
    found, edges, _ = _program(t)
    pieces = found.where(F.substring_index("node", "::", -1).isin("Shop.create_order", "greet")).select("node", "path", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
    marks = pieces.where(F.col("node").endswith("create_order")).select("path", F.col("line_start").alias("line_no"), F.explode(F.array(F.lit("R2"), F.lit("R1"))).alias("rule_id"))
    return review.context(pieces, edges, found, marks)


def _plain_reviewer(prompt: str) -> str:
    """Stands for a model: finds what raises, in the form that a model answers in."""
    if "fail" in prompt:
        raise TimeoutError
    at = [i for i, line in enumerate(prompt.split("\n"), 1) if "raise " in line]
    found = [{"title": "raises", "category": "logic", "severity": "low", "confidence": 7, "line_start": i, "line_end": i, "description": "", "evidence": "raise"} for i in at]
    return "Sure.\n```json\n" + json.dumps({"findings": found}) + "\n```" if "def strict" not in prompt else "no findings"


@query("SELECT s_suppkey || '/app.py::parse' AS node, 'raises' AS title, 3 AS line_start, 7 AS confidence FROM supplier")
def review_answers(t):
    """Functions of a small program under a reviewer that is a plain function; one answer cannot be read."""
    found = summaries.functions(projects_of(t, FILES))
    said = review.findings_in(review.answers(found.select("node", F.col("body").alias("prompt")), _plain_reviewer))
    return said.select("node", "title", "line_start", "confidence")


@query(f"""WITH {SQL_ROWS}, d AS (SELECT DISTINCT path, line_no FROM t) SELECT path, line_no FROM d WHERE NOT (line_no % 3 = 0)""")
def critic_filter(t):
    """Three explorers that say the same, and a critic that refuses each third line."""
    rows = rows_of(t).select("path", "line_no")
    votes = rows.distinct().select("path", "line_no", F.when(F.col("line_no") % 3 == 0, '{"verdict": "false"}').when(F.col("line_no") % 3 == 1, '{"verdict": "true"}').otherwise("no idea").alias("answer"))
    return review.critic_keeps(rows.unionByName(rows).unionByName(rows), votes, ["path", "line_no"], ["path"])


@query("""WITH f AS (SELECT l_orderkey % 5 AS node, l_partkey AS origin, min(l_linenumber) AS depth, bool_or(l_quantity > 49) AS sensitive FROM lineitem WHERE l_partkey < 40 GROUP BY 1, 2)
SELECT o_orderkey AS id, arg_min(origin, (NOT sensitive, depth, origin)) AS origin, arg_min(depth, (NOT sensitive, depth, origin)) AS depth, bool_or(sensitive) AS sensitive FROM orders JOIN f ON o_orderkey % 5 = node WHERE o_orderkey < 50 GROUP BY 1""")
def best_process(t):
    flows = t("lineitem").where("l_partkey < 40").groupBy((F.col("l_orderkey") % 5).alias("node"), F.col("l_partkey").alias("origin")).agg(F.min("l_linenumber").alias("depth"), F.max(F.col("l_quantity") > 49).alias("sensitive"))
    found = t("orders").where("o_orderkey < 50").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("node"))
    return review.best_process(found, flows)


_TREE = [("src/app/dao/user.py", "python"), ("lib/x/__init__.py", "python"), ("tool.py", "python"), ("src/main/java/org/shop/cart/Basket.java", "java"), ("Main.java", "java"), ("pkg/dao/user.go", "go"), ("main.go", "go"), ("src/web/view.ts", "typescript")]
_PACKAGES = ["app.dao.user", "x", "tool", "org.shop.cart", "Main", "pkg/dao", "", "web.view"]


@query(f"SELECT path, package, count(*) AS n FROM part JOIN {values([(i, p, x) for i, ((p, _), x) in enumerate(zip(_TREE, _PACKAGES, strict=True))])} e(i, path, package) ON p_partkey % {len(_TREE)} = i GROUP BY 1, 2")
def path_packages(t):
    files = files_of(t, [(p, lang, "") for p, lang in _TREE], "part", "p_partkey")
    path = F.substring("path", F.instr("path", "/") + 1, F.length("path"))
    return files.select(path.alias("path"), "lang").groupBy("path", source_files.package_of(F.col("path"), F.col("lang")).alias("package")).agg(F.count("*").alias("n"))


_SKIPS = [("src/a.py", 0), ("node_modules/a.js", 1), (".github/a.yml", 0), (".hidden/a.py", 1), ("jdk-17/a.java", 1), ("a.egg-info/x.py", 1), ("a/b.PNG", 1), ("a/readme.md", 1), ("a/api_pb2.py", 2), ("a/x.generated.ts", 2), ("usr/lib/x.py", 1), ("a/user_types.py", 2)]


@query(f"SELECT path, skip = 1 AS skipped, skip = 2 AS generated, count(*) AS n FROM part JOIN {values([(i, p, k) for i, (p, k) in enumerate(_SKIPS)])} e(i, path, skip) ON p_partkey % {len(_SKIPS)} = i GROUP BY ALL")
def skipped_paths(t):
    files = files_of(t, [(p, "x", "") for p, _ in _SKIPS], "part", "p_partkey")
    path = F.substring("path", F.instr("path", "/") + 1, F.length("path"))
    files = files.select(path.alias("path"))
    return files.groupBy("path", source_files.skipped(F.col("path")).alias("skipped"), source_files.generated_name(F.col("path")).alias("generated")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM documents")
def file_counts(t):
    return source_files.file_counts(t("documents").select("lang"))


@query("""SELECT o_orderkey, coalesce(o_orderpriority, '') || '::' || o_custkey || '::' || (o_orderkey % 50) || '::' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 ELSE o_orderkey % 50 + 3 END AS signature,
lower(o_orderstatus) || '::' || lower(o_orderpriority) || '::' || o_custkey || '::' || 'a b' AS semantic FROM orders""")
def finding_signatures(t):
    first = (F.col("o_orderkey") % 50).cast("int")
    last = F.when(F.col("o_orderkey") % 2 == 0, F.lit(None).cast("int")).otherwise(first + 3)
    path = F.col("o_custkey").cast("string")
    return t("orders").select("o_orderkey", source_findings.signature(F.col("o_orderpriority"), path, first, last).alias("signature"), source_findings.semantic_key(F.col("o_orderstatus"), F.col("o_orderpriority"), path, F.lit("  A \t b ")).alias("semantic"))
