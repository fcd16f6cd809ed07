"""Roll-ups and links of findings on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import code, findings, graph, metrics
from quarryline.plans.core_queries import SQL_DAYS, SQL_EDGES, SQL_FINDINGS, SQL_LINES_TABLE, SQL_SEVERITY, edges_of, findings_of, lines_of, two_days
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


@query(f"""WITH {SQL_FINDINGS}, d AS (SELECT *, CASE category WHEN 'security' THEN 'security' WHEN 'defect' THEN 'defects' WHEN 'testing' THEN 'testing' ELSE 'complexity' END AS dimension FROM h),
s AS (SELECT dimension, count(*) AS findings, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM d GROUP BY 1),
p AS (SELECT dimension, o_orderkey, row_number() OVER (PARTITION BY dimension ORDER BY {SQL_SEVERITY}, priority, o_orderkey) AS n FROM d QUALIFY n <= 3),
i AS (SELECT dimension, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) AS top_issues FROM p GROUP BY 1),
m AS (SELECT 'scale' AS dimension, count(*) AS metrics FROM nation),
a AS (SELECT dimension, coalesce(score, 100.0) AS score, coalesce(findings, 0) AS findings, coalesce(metrics, 0) AS metrics, coalesce(top_issues, '') AS top_issues FROM s FULL JOIN m USING (dimension) LEFT JOIN i USING (dimension))
SELECT *, CASE WHEN score >= 75 THEN 'good' WHEN score >= 40 THEN 'warning' ELSE 'critical' END AS status FROM a""")
def dimension_scores(t):
    rows = findings_of(t).withColumn("dimension", findings.dimension(F.lit(None).cast("string"), F.col("category")))
    return findings.dimension_scores(rows, t("nation").select(F.lit("scale").alias("dimension")), "o_orderkey")


@query(f"""WITH {SQL_FINDINGS}, s AS (SELECT module, count(*) AS findings, sum(blocks::INT)::BIGINT AS blocking, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM h GROUP BY 1),
c AS (SELECT module, category, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, category) AS n FROM f GROUP BY 1, 2 QUALIFY n = 1)
SELECT module, findings, blocking, score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 70 THEN 'medium' WHEN score >= 50 THEN 'high' ELSE 'critical' END AS risk,
CASE WHEN blocking > 0 OR score < 50 THEN 'immediate_refactor' WHEN score < 80 THEN 'plan_refactor' ELSE 'continue_observing' END AS advice, category AS dominant FROM s JOIN c USING (module)""")
def module_profiles(t):
    return findings.module_profiles(findings_of(t), "module", "category")


@query(f"""WITH {SQL_FINDINGS} SELECT module, row_number() OVER (PARTITION BY module ORDER BY {SQL_SEVERITY}, CASE priority WHEN 'must-fix' THEN 0 WHEN 'should-fix' THEN 1 ELSE 2 END, round(deduction, 6) DESC, o_orderkey)::INT AS place,
o_orderkey, severity, priority FROM h QUALIFY place <= 5""")
def module_top_findings(t):
    return findings.module_top(findings_of(t), "module", "o_orderkey")


@query(f"""WITH {SQL_FINDINGS} SELECT category, severity, (o_orderkey % 2 = 0 AND blocks) OR (confidence = 'high' AND ((category = 'security' AND severity IN ('critical', 'high')) OR (category IN ('defect', 'testing') AND severity = 'critical'))) AS blocking,
CASE confidence WHEN 'high' THEN 'likely' WHEN 'medium' THEN 'suspected' ELSE 'needs-review' END AS evidence, count(*) AS n FROM f GROUP BY ALL""")
def blocking_and_evidence(t):
    rows = findings_of(t)
    forced = (F.col("o_orderkey") % 2 == 0) & F.col("blocks")
    blocking = findings.is_blocking(forced, F.col("category"), F.col("severity"), F.col("confidence"))
    return rows.groupBy("category", "severity", blocking.alias("blocking"), findings.evidence_level(F.lit("NONE"), F.col("confidence")).alias("evidence")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
o AS (SELECT user_id, round(sum(v), 2) AS changed, sum(n)::BIGINT AS commits, count(*) AS authors, arg_min(event_type, (-n, event_type)) AS top_author, round(max(n) / sum(n), 3) AS top_share FROM a GROUP BY 1)
SELECT * FROM o WHERE commits >= 2 AND top_share >= 0.25 ORDER BY top_share DESC, changed DESC, user_id LIMIT 10""")
def ownership_risk(t):
    by = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    owner = F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"]
    owned = by.groupBy("user_id").agg(F.round(F.sum("v"), 2).alias("changed"), F.sum("n").alias("commits"), F.count("*").alias("authors"), owner.alias("top_author"), F.round(F.max("n") / F.sum("n"), 3).alias("top_share"))
    return findings.ownership_risk(owned, "user_id", 2, 0.25)


@query(f"""WITH {SQL_DAYS}, a AS (SELECT user_id, md5(count(*)::VARCHAR) AS h FROM d, e WHERE day = today - 1 GROUP BY 1), b AS (SELECT user_id, md5(count(*)::VARCHAR) AS h FROM d, e WHERE day = today GROUP BY 1)
SELECT user_id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM a FULL JOIN b USING (user_id) WHERE a.h IS DISTINCT FROM b.h""")
def file_states(t):
    digest = lambda df: df.groupBy("user_id").agg(F.md5(F.count("*").cast("string")).alias("h"))
    return findings.file_states(*map(digest, two_days(t)), "user_id", "h")


@query(f"""WITH {SQL_LINES_TABLE}, r AS (SELECT doc_id, line_no FROM l WHERE contains(line, '!!') OR contains(line, '###')), k AS (SELECT doc_id, line_no FROM l WHERE contains(line, 'License') OR regexp_matches(line, '[.]$'))
SELECT r.doc_id, r.line_no::INT AS line_no, arg_min(k.line_no, (k.line_no <> r.line_no, k.line_no))::INT AS match FROM r JOIN k ON r.doc_id = k.doc_id AND abs(k.line_no - r.line_no) <= 3 GROUP BY 1, 2""")
def nearest_match(t):
    lines = lines_of(t)
    return findings.nearest_match(lines.where(F.col("line").contains("!!") | F.col("line").contains("###")), lines.where(F.col("line").contains("License") | F.col("line").rlike("[.]$")), "doc_id")


@query("""WITH RECURSIVE s AS (SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN 1 ELSE s_suppkey // 3 END AS parent FROM supplier), c(s_suppkey, chain) AS (SELECT s_suppkey, [s_suppkey] FROM s
UNION ALL SELECT c.s_suppkey, list_append(chain, n.parent) FROM c JOIN s n ON chain[-1] = n.s_suppkey WHERE NOT list_contains(chain, n.parent) AND len(chain) <= 20)
SELECT s_suppkey, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM c GROUP BY 1""")
def first_parent_chains(t):
    """Suppliers as classes in a tree, whose two first are each other's parent."""
    classes = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") == 0, 1).otherwise(F.floor(F.col("s_suppkey") / 3)).alias("parent"))
    return findings.chains(classes, "s_suppkey", "parent").select("s_suppkey", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


@query(f"""WITH RECURSIVE {SQL_EDGES}, o AS (SELECT DISTINCT caller FROM e WHERE caller NOT IN (SELECT callee FROM e WHERE confidence >= 1)),
r(origin, node, depth) AS (SELECT caller, caller, 0 FROM o UNION SELECT origin, callee, depth + 1 FROM r JOIN e ON node = e.caller WHERE depth < 4 AND confidence >= 0.92),
m AS (SELECT origin, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT origin, count(*) AS functions, max(depth) AS max_depth FROM m GROUP BY 1 HAVING count(*) > 2""")
def process_trees(t):
    edges = edges_of(t)
    return graph.processes(edges.where("confidence >= 0.92"), graph.entry_points(edges, 1.0), 4)


@query(f"""WITH {SQL_EDGES}, x AS (SELECT DISTINCT caller, callee FROM e WHERE caller <> callee), o AS (SELECT caller AS node, count(*) AS fan_out FROM x GROUP BY 1), i AS (SELECT callee AS node, count(*) AS fan_in FROM x GROUP BY 1),
s AS (SELECT node, round(coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0)), 3) AS k FROM o FULL JOIN i USING (node))
SELECT caller, callee, a.k AS source_instability, b.k AS target_instability FROM x JOIN s a ON caller = a.node JOIN s b ON callee = b.node WHERE a.k < 0.6 AND b.k > 0.4""")
def unstable_dependencies(t):
    return metrics.unstable(edges_of(t), 0.6, 0.4)


@query(f"""WITH {SQL_LINES_TABLE}, m AS (SELECT doc_id, lang, count(*) AS loc, 1 + sum(contains(line, ',')::INT) AS cc FROM l GROUP BY 1, 2)
SELECT lang, count(*) AS documents, round(avg(greatest(0.0, least(100.0, 171 - 5.2 * ln(8 * loc) - 0.23 * cc - 16.2 * ln(loc)))), 3) AS maintainability FROM m GROUP BY 1""")
def maintainability_by_lang(t):
    sizes = lines_of(t).groupBy("doc_id", "lang").agg(F.count("*").alias("loc"), (1 + F.sum(F.col("line").contains(",").cast("int"))).alias("cc"))
    return sizes.groupBy("lang").agg(F.count("*").alias("documents"), F.round(F.avg(code.maintainability(F.col("loc"), F.col("cc"))), 3).alias("maintainability"))


@query("SELECT role, count(*) AS turns, sum(length(coalesce(text, '')) // 4 + 500)::BIGINT AS tokens FROM conversations GROUP BY 1")
def token_totals(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(findings.tokens(F.col("text"))).alias("tokens"))
