"""The operators on the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import diff, folds, graph, metrics, risk, rules
from quarryline.operators.lines import explode_lines
from quarryline.plans.line_queries import SQL_LINES
from quarryline.session import scratch_path
from quarryline.sources.tables import table
from quarryline.streaming.watch import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``t``, which reads a table by name, with its SQL."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: table(spark, sf_dir, name))

        QUERIES[make.__name__] = run
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return register


SQL_LINES_TABLE = f"l AS (SELECT doc_id, source, lang, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT doc_id, source, lang, {SQL_LINES} AS x FROM documents))"


def lines_of(t) -> DataFrame:
    return explode_lines(t("documents"), ["doc_id", "source", "lang"])


RULES = {"LICENSE": "License", "TABLE": r" \| ", "SHOUT": "!!", "MARKUP": "###"}
_HITS = " UNION ALL ".join(f"SELECT doc_id, line_no, '{r}' AS rule_id FROM l WHERE regexp_matches(line, '{p}')" for r, p in RULES.items())


@query(f"""WITH {SQL_LINES_TABLE}, c AS (SELECT source, doc_id, line_no, regexp_replace(regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'), '[ \\t\\r]+', ' ', 'g') AS b FROM l),
n AS (SELECT *, row_number() OVER w AS pos, list(b) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS block
  FROM c WHERE b <> '' AND NOT starts_with(b, '#') AND NOT starts_with(b, '//') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
k AS (SELECT source, doc_id, pos, block, count(*) OVER (PARTITION BY source, block) AS c FROM n WHERE len(block) = 6),
m AS (SELECT DISTINCT source, doc_id, unnest(range(pos, pos + 6)) AS pos FROM k WHERE c > 1)
SELECT source, code_lines, coalesce(d, 0) AS duplicate_lines, round(least(100.0, 100.0 * coalesce(d, 0) / code_lines), 1) AS duplication_rate
FROM (SELECT source, count(*) AS code_lines FROM n GROUP BY 1) LEFT JOIN (SELECT source, count(*) AS d FROM m GROUP BY 1) USING (source)""")
def duplication_rate_by_source(t):
    return metrics.text_duplication(t("documents"), ["source"], "doc_id")


SECRET = r"(password|secret|token|api_key)[ ]*[:=][ ]*[\"']?([A-Za-z0-9_./+-]{8,})"


@query(f"""WITH {SQL_LINES_TABLE}, h AS (SELECT doc_id, line_no, regexp_extract(line, '(password|secret|token|api_key)[ ]*[:=][ ]*["'']?([A-Za-z0-9_./+-]{{8,}})', 2) AS value FROM l),
v AS (SELECT * FROM h WHERE value <> '' AND NOT (regexp_matches(value, '^[$%]') OR lower(value) IN ('changeme','password','secret','your_secret_here','your_api_key_here','xxx','todo','fixme','placeholder','your_password_here','replace_me','none','null','undefined',
  'admin','administrator','root','localhost','guest','user','test','demo','default','qwerty','letmein','welcome','12345','123456','123456789','111111','000000','123321','654321') OR (length(value) < 8 AND regexp_matches(lower(value), '^([0-9]+|[a-z]+)$'))))
SELECT doc_id, value, min(line_no)::INT AS line_no FROM v GROUP BY ALL""")
def secret_line_hits(t):
    hits = lines_of(t).select("doc_id", "line_no", F.regexp_extract("line", SECRET, 2).alias("value")).where("value <> ''")
    return rules.first_of(hits.where(rules.plausible_secret(F.col("value"))), ["doc_id", "value"], ["line_no"])


@query(f"""WITH {SQL_LINES_TABLE}, m AS (SELECT doc_id, line_no, regexp_matches(line, '[.]$') AS hit, contains(line, '!!') OR contains(line, '###') AS mark FROM l),
p AS (SELECT *, coalesce(lag(mark) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS above FROM m)
SELECT doc_id, line_no::INT AS line_no FROM p WHERE hit AND NOT mark AND NOT above""")
def suppressed_hits(t):
    return rules.unsuppressed(lines_of(t), "doc_id", F.col("line").rlike("[.]$"), F.col("line").contains("!!") | F.col("line").contains("###")).select("doc_id", "line_no")


@query(f"WITH {SQL_LINES_TABLE} SELECT rule_id, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM ({_HITS}) GROUP BY 1")
def rule_hits(t):
    return rules.match_lines(lines_of(t), RULES).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT page_id, url FROM pages WHERE contains(html, '<script') AND contains(html, '<nav') AND NOT contains(html, '<table')")
def doc_presence_absence(t):
    return rules.presence_absence(t("pages"), "html", ["<script", "<nav"], ["<table"]).select("page_id", "url")


@query(f"""WITH {SQL_LINES_TABLE}, h AS (SELECT doc_id, line_no FROM l WHERE contains(line, 'License'))
SELECT h.doc_id, h.line_no::INT AS line_no, string_agg(lpad(l.line_no::VARCHAR, 4, ' ') || ': ' || line, chr(10) ORDER BY l.line_no) AS snippet
FROM h JOIN l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY ALL""")
def hit_snippets(t):
    lines = lines_of(t)
    return rules.snippets(lines, lines.where(F.col("line").contains("License")).select("doc_id", "line_no"), "doc_id")


@query("SELECT p_brand AS rule_id, lower(p_type) AS tag, count(*) AS parts FROM part WHERE p_type IN ('SMALL','PROMO','LARGE') AND p_size >= 25 AND p_brand NOT IN ('Brand#11') GROUP BY 1, 2")
def rule_filter(t):
    grade = F.when(F.col("p_size") >= 40, "critical").when(F.col("p_size") >= 25, "high").otherwise("low")
    catalog = t("part").select(F.col("p_brand").alias("rule_id"), "p_type", F.array(F.lower("p_type")).alias("tags"), grade.alias("severity"), F.array().cast("array<string>").alias("languages"))
    kept = rules.select_rules(catalog, deny=["brand#11"], with_tags=["small", "PROMO", "large"], without_tags=["economy"], min_severity="high", language="Any")
    return kept.groupBy("rule_id", F.lower("p_type").alias("tag")).agg(F.count("*").alias("parts"))


@query(f"""WITH {SQL_LINES_TABLE}, h AS ({_HITS}), b AS (SELECT DISTINCT rule_id, line_no FROM h JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT doc_id, line_no::INT AS line_no, rule_id FROM h JOIN documents USING (doc_id) WHERE lang <> 'en' AND (rule_id, line_no) NOT IN (SELECT (rule_id, line_no) FROM b)""")
def baseline_new_hits(t):
    hits = rules.match_lines(lines_of(t), RULES)
    return diff.beyond_baseline(hits.where("lang <> 'en'"), hits.where("lang = 'en'"), ["rule_id", "line_no"]).select("doc_id", "line_no", "rule_id")


SQL_DAYS = "d AS (SELECT *, ts::DATE AS day FROM events), e AS (SELECT max(day) AS today FROM d)"


def two_days(t):
    events = t("events").withColumn("day", F.to_date("ts"))
    today = events.agg(F.max("day").alias("today"))  # one row
    both = events.join(F.broadcast(today))
    return both.where("day = today - interval 1 day"), both.where("day = today")


@query(f"""WITH {SQL_DAYS}, a AS (SELECT DISTINCT user_id, event_type FROM d, e WHERE day = today - 1), b AS (SELECT DISTINCT user_id, event_type FROM d, e WHERE day = today),
x AS (SELECT user_id, event_type, 'new' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT user_id, event_type, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
SELECT user_id, event_type, status, (SELECT max(event_id) FROM d, e WHERE d.user_id = x.user_id AND d.event_type = x.event_type AND day = CASE status WHEN 'new' THEN today ELSE today - 1 END) AS event_id FROM x""")
def snapshot_diff(t):
    return diff.snapshot_diff(*two_days(t), ["user_id", "event_type"], "event_id")


@query(f"""WITH {SQL_DAYS}, a AS (SELECT event_type, sum(value) AS v FROM d, e WHERE day = today - 1 GROUP BY 1), b AS (SELECT event_type, sum(value) AS v FROM d, e WHERE day = today GROUP BY 1)
SELECT event_type, round(coalesce(a.v, 0), 2) AS before, round(coalesce(b.v, 0), 2) AS after, round(coalesce(b.v, 0) - coalesce(a.v, 0), 2) AS delta
FROM a FULL JOIN b USING (event_type) WHERE abs(coalesce(b.v, 0) - coalesce(a.v, 0)) >= 0.001""")
def metric_deltas(t):
    total = lambda df: df.groupBy("event_type").agg(F.sum("value").alias("v"))
    return diff.metric_deltas(*map(total, two_days(t)), "event_type", "v", places=2)


@query("""WITH a AS (SELECT event_type, user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, round(sum(v), 2) AS changed, sum(n)::BIGINT AS commits, count(*) AS authors, arg_max(user_id, (n, -user_id)) AS top_author, round(max(n) / sum(n), 3) AS top_share FROM a GROUP BY 1""")
def ownership_share(t):
    return metrics.ownership(t("events"), "event_type", "user_id", "value")


@query("""SELECT count(*) AS commits, greatest(1, floor(((epoch(max(ts))::BIGINT) - (epoch(min(ts))::BIGINT)) / 86400) + 1)::BIGINT AS days,
round(count(*) / greatest(1, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) + 1), 2) AS per_day FROM events""")
def churn_per_day(t):
    return metrics.churn_per_day(t("events"), "ts")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS changed, count(*) AS commits FROM orders GROUP BY 1 HAVING count(*) >= 12 OR round(sum(o_totalprice), 2) >= 3000000 ORDER BY changed DESC, commits DESC, o_custkey LIMIT 10")
def hotspots_topk(t):
    return metrics.hotspots(t("orders"), "o_custkey", "o_totalprice", 12, 3_000_000)


@query("SELECT l_suppkey, sum((l_linestatus = 'F')::INT)::BIGINT AS covered, count(*) AS total, round(100.0 * sum((l_linestatus = 'F')::INT) / count(*), 1) AS percent FROM lineitem GROUP BY 1")
def weighted_coverage(t):
    return metrics.coverage(t("lineitem"), ["l_suppkey"], F.col("l_linestatus") == "F")


@query("""SELECT * FROM (SELECT l_suppkey, sum((l_linestatus = 'F')::INT)::BIGINT AS covered, count(*) AS total, round(100.0 * sum((l_linestatus = 'F')::INT) / count(*), 1) AS percent FROM lineitem GROUP BY 1)
WHERE percent < 60 ORDER BY percent, total DESC, l_suppkey LIMIT 10""")
def weakest_coverage(t):
    return metrics.weakest(metrics.coverage(t("lineitem"), ["l_suppkey"], F.col("l_linestatus") == "F"), "l_suppkey", 60)


@query("""SELECT l_returnflag, sum((l_linestatus = 'F')::INT)::BIGINT AS covered, count(*) AS total, round(100.0 * sum((l_linestatus = 'F')::INT) / count(*), 1) AS percent
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2000-01-01') GROUP BY 1""")
def change_coverage(t):
    changed = t("orders").where("o_orderdate >= date '2000-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    return metrics.coverage(t("lineitem").join(changed, "l_orderkey", "left_semi"), ["l_returnflag"], F.col("l_linestatus") == "F")


# Nations as modules: an edge for each pair in which a customer's nation orders from a supplier's; confidence is the
# pair's share of the supplier's nation over the caller's largest such share.
SQL_EDGES = """n AS (SELECT c_nationkey AS caller, s_nationkey AS callee, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
l AS (SELECT caller, callee, n / sum(n) OVER (PARTITION BY callee)::BIGINT AS share FROM n),
g AS (SELECT caller, callee, round(share / max(share) OVER (PARTITION BY caller), 6) AS confidence FROM l), e AS (SELECT * FROM g WHERE confidence >= 0.9)"""


def edges_of(t, least: float = 0.9) -> DataFrame:
    pairs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = pairs.groupBy(F.col("c_nationkey").alias("caller"), F.col("s_nationkey").alias("callee")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("callee")))
    top = F.max("share").over(Window.partitionBy("caller"))
    return shares.select("caller", "callee", F.round(F.col("share") / top, 6).alias("confidence")).where(F.col("confidence") >= least)


@query(f"""WITH {SQL_EDGES}, x AS (SELECT DISTINCT caller, callee FROM e WHERE caller <> callee), o AS (SELECT caller AS node, count(*) AS fan_out FROM x GROUP BY 1), i AS (SELECT callee AS node, count(*) AS fan_in FROM x GROUP BY 1)
SELECT node, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, round(coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0)), 3) AS instability FROM o FULL JOIN i USING (node)""")
def fan_in_out_instability(t):
    return metrics.fan(edges_of(t), "caller", "callee")


@query(f"WITH {SQL_EDGES} SELECT caller, callee, confidence, row_number() OVER (PARTITION BY caller ORDER BY confidence DESC, callee)::INT AS rank FROM e QUALIFY rank <= 3")
def direct_neighbours(t):
    return graph.neighbours(edges_of(t), 0.9, top=3)


_R = f"""WITH RECURSIVE {SQL_EDGES}, r(origin, node, hops) AS (SELECT DISTINCT caller, callee, 1 FROM e WHERE caller <> callee
UNION SELECT origin, callee, hops + 1 FROM r JOIN e ON node = caller WHERE hops < 3)"""


@query(f"{_R} SELECT origin, node, min(hops) AS hops FROM r WHERE origin <> node GROUP BY 1, 2")
def reach_k(t):
    return graph.reach(edges_of(t), 3)


@query(f"""WITH RECURSIVE {SQL_EDGES}, p(nodes, hops, confidence) AS (SELECT [caller, callee], 1, confidence FROM e WHERE caller = 3 AND caller <> callee
UNION ALL SELECT list_append(nodes, callee), hops + 1, least(p.confidence, e.confidence) FROM p JOIN e ON nodes[-1] = caller WHERE hops < 3 AND NOT list_contains(nodes, callee))
SELECT array_to_string(nodes, '>') AS path, hops, confidence FROM p""")
def simple_paths(t):
    return graph.simple_paths(edges_of(t), 3, 3)


@query(f"""WITH RECURSIVE {SQL_EDGES}, r(origin, node, hops) AS (SELECT DISTINCT caller, callee, 1 FROM e WHERE caller <> callee
UNION SELECT origin, callee, hops + 1 FROM r JOIN e ON node = caller WHERE hops < 4 AND caller <> callee) SELECT origin AS node, min(hops) AS cycle_length FROM r WHERE origin = node GROUP BY 1""")
def link_cycles(t):
    return graph.in_cycle(edges_of(t), 4)


@query(f"WITH {SQL_EDGES} SELECT DISTINCT caller AS node FROM e WHERE caller NOT IN (SELECT callee FROM e WHERE confidence >= 0.97)")
def entry_points(t):
    return graph.entry_points(edges_of(t), 0.97)


@query(f"""WITH RECURSIVE {SQL_EDGES}, f(node, round) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 7 UNION SELECT caller, round + 1 FROM f JOIN e ON callee = node WHERE round < 6)
SELECT node, min(round) AS round FROM f GROUP BY 1""")
def fixpoint_flag(t):
    return graph.propagate_flag(edges_of(t), t("nation").where("n_nationkey = 7").select(F.col("n_nationkey").alias("node")))


@query(f"""WITH {SQL_EDGES}, i AS (SELECT callee AS node, count(*) AS n FROM e GROUP BY 1), s AS (SELECT e.callee, sum(i.n) AS m FROM (SELECT DISTINCT caller, callee FROM e WHERE caller <> callee) e JOIN i ON e.caller = i.node GROUP BY 1),
k AS (SELECT node, (n + coalesce(m, 0))::BIGINT AS edges FROM i LEFT JOIN s ON node = callee)
SELECT node, edges, (CASE WHEN edges <= 3 THEN 10 * edges WHEN edges <= 10 THEN 30 + 5 * (edges - 3) ELSE least(100, 65 + 3 * (edges - 10)) END)::BIGINT AS impact FROM k""")
def impact_score(t):
    return graph.impact(edges_of(t), 0.9)


@query("""WITH i AS (SELECT l_orderkey AS k, epoch(l_shipdate)::BIGINT // 86400 - l_quantity::BIGINT AS lo, epoch(l_shipdate)::BIGINT // 86400 AS hi FROM lineitem),
p AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT // 86400 AS d FROM orders)
SELECT o.k AS order_id, arg_min(lo, (hi - lo, lo)) AS lo, arg_min(hi, (hi - lo, lo)) AS hi, min(hi - lo) AS span FROM p o JOIN i ON o.k = i.k AND d BETWEEN lo AND hi GROUP BY 1""")
def enclosing_interval(t):
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    spans = t("lineitem").select(F.col("l_orderkey").alias("k"), (day("l_shipdate") - F.col("l_quantity").cast("long")).alias("lo"), day("l_shipdate").alias("hi"))
    points = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("order_id"), day("o_orderdate").alias("at"))
    return graph.enclosing_interval(points, spans, "k", "at", "order_id")


# Orders as findings.
SQL_FINDINGS = """f AS (SELECT o_orderkey, o_custkey, c_mktsegment AS segment, n_name AS module, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence, CASE c_mktsegment WHEN 'BUILDING' THEN 'security' WHEN 'MACHINERY' THEN 'defect' WHEN 'AUTOMOBILE' THEN 'testing' ELSE 'maintainability' END AS category,
  o_orderpriority = '1-URGENT' AND o_totalprice > 450000 AS blocks FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT *, CASE WHEN blocks OR (severity = 'critical' AND confidence = 'high') THEN 'must-fix' WHEN severity IN ('critical', 'high') OR (severity = 'medium' AND confidence = 'high') THEN 'should-fix' ELSE 'can-fix' END AS priority FROM f),
h AS (SELECT *, least(60.0, 100.0 * (0.25 * CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.55 WHEN 'low' THEN 0.3 ELSE 0.1 END
  + 0.2 * CASE WHEN blocks THEN 1.0 WHEN category IN ('security', 'defect') THEN 0.82 WHEN category = 'testing' THEN 0.68 ELSE 0.58 END
  + 0.15 * CASE WHEN category IN ('security', 'defect') THEN 0.8 WHEN category = 'testing' THEN 0.76 ELSE 0.6 END + 0.15 * 0.62
  + 0.08 * CASE category WHEN 'testing' THEN 0.92 WHEN 'security' THEN 0.86 ELSE 0.8 END
  + 0.08 * CASE WHEN blocks OR category = 'security' THEN 0.9 WHEN category IN ('maintainability', 'defect') THEN 0.72 ELSE 0.58 END
  + 0.01 * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END)
  + CASE WHEN blocks THEN 8.0 ELSE 0 END + CASE priority WHEN 'must-fix' THEN 5.0 WHEN 'should-fix' THEN 2.5 ELSE 0 END)::DOUBLE AS deduction FROM g)"""
SQL_SEVERITY = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def findings_of(t) -> DataFrame:
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    severity = risk.lookup({"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}, F.col("o_orderpriority"), "info")
    category = risk.lookup({"BUILDING": "security", "MACHINERY": "defect", "AUTOMOBILE": "testing"}, F.col("c_mktsegment"), "maintainability")
    confidence = risk.lookup({"F": "high", "O": "medium"}, F.col("o_orderstatus"), "low")
    blocks = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450_000)
    return rows.select("o_orderkey", "o_custkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("module"), severity.alias("severity"), confidence.alias("confidence"), category.alias("category"), blocks.alias("blocks"))


@query(f"WITH {SQL_FINDINGS} SELECT o_custkey, count(*) AS findings, sum(blocks::INT)::BIGINT AS blocking, round(30000.0 / (300.0 + sum(deduction)), 1) AS score FROM h GROUP BY 1")
def risk_score_by_group(t):
    return risk.score(findings_of(t), ["o_custkey"])


@query(f"""WITH {SQL_FINDINGS} SELECT segment, o_orderkey, priority, row_number() OVER (PARTITION BY segment ORDER BY CASE priority WHEN 'must-fix' THEN 0 WHEN 'should-fix' THEN 1 ELSE 2 END, {SQL_SEVERITY}, (confidence <> 'high')::INT, o_orderkey)::INT AS place
FROM g QUALIFY place <= 20""")
def priority_order(t):
    rows = findings_of(t).withColumn("priority", risk.priority())
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*risk.priority_order(), "o_orderkey"))
    return rows.select("segment", "o_orderkey", "priority", place.alias("place")).where("place <= 20")


@query(f"""WITH {SQL_FINDINGS} SELECT category, count(*) AS size, arg_min(severity, {SQL_SEVERITY}) AS worst, count(DISTINCT module) AS modules, array_to_string(list_sort(list(DISTINCT module))[1:5], ',') AS first_modules FROM f GROUP BY 1 HAVING count(*) >= 2""")
def systemic_clusters(t):
    return risk.clusters(findings_of(t), "category", "module")


@query(f"""WITH {SQL_FINDINGS} SELECT module, count(*) AS findings, round(sum(w), 1) AS hours, round(sum(w) / 8, 2) AS days FROM (SELECT module, (CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.5 ELSE 0.1 END)::DOUBLE AS w FROM f) GROUP BY 1""")
def tech_debt(t):
    return risk.tech_debt(findings_of(t), ["module"])


_FACTS = "k AS (SELECT count(*) AS findings_total, " + ", ".join(f"sum((severity = '{s}')::INT)::BIGINT AS findings_{s}" for s in risk.SEVERITY) + ", sum(blocks::INT)::BIGINT AS findings_blocking, round(30000.0 / (300.0 + sum(deduction)), 1) AS project_score FROM h)"
GATE = [("score", "project.score >= 60%", "fail"), ("blocking", "findings.blocking == 0 and findings.critical < 100000", "fail"), ("either", "findings.low > 10 or findings.total < 5", "warn"), ("unknown", "coverage.lines >= 80", "fail")]


@query(f"WITH {SQL_FINDINGS}, {_FACTS} SELECT * FROM k")
def gate_facts(t):
    return risk.gate_facts(findings_of(t).withColumn("priority", risk.priority()).withColumn("deduction", risk.deduction()))


@query(f"""WITH {SQL_FINDINGS}, {_FACTS} SELECT 'score' AS rule, 'fail' AS action, project_score >= 60 AS passed FROM k UNION ALL SELECT 'blocking', 'fail', findings_blocking = 0 AND findings_critical < 100000 FROM k
UNION ALL SELECT 'either', 'warn', findings_low > 10 OR findings_total < 5 FROM k UNION ALL SELECT 'unknown', 'fail', true""")
def gate_eval(t):
    return risk.gate(gate_facts(t), GATE)


@query(f"""WITH {SQL_FINDINGS}, s AS (SELECT module, sum(blocks::INT) AS b, round(30000.0 / (300.0 + sum(deduction)), 1) AS score, sum((severity IN ('critical', 'high'))::INT) AS serious FROM h GROUP BY 1)
SELECT module, score, CASE WHEN b > 0 THEN 'blocked' WHEN score < 50 THEN 'not_recommended' WHEN score < 80 OR serious > 0 THEN 'conditional' ELSE 'recommended' END AS verdict FROM s""")
def release_verdict(t):
    rows = findings_of(t)
    serious = rows.groupBy("module").agg(F.sum(F.col("severity").isin("critical", "high").cast("int")).alias("serious"))
    return risk.score(rows, ["module"]).join(serious, "module").select("module", "score", risk.verdict(F.col("blocking"), F.col("score"), F.col("serious")).alias("verdict"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n, sum((event_type = 'error')::INT) AS errors, sum((event_type = 'purchase')::INT) AS buys FROM events GROUP BY 1, 2),
c AS (SELECT user_id, arg_max(n, day) - arg_min(n, day) AS s, arg_max(errors, day) - arg_min(errors, day) AS e, arg_max(buys, day) - arg_min(buys, day) AS b FROM d GROUP BY 1)
SELECT user_id, CASE WHEN s <= -5 OR e > 0 OR b > 0 THEN 'regressing' WHEN s >= 5 AND e <= 0 AND b <= 0 THEN 'improving' ELSE 'stable' END AS trend FROM c""")
def trend_class(t):
    count = lambda kind: F.sum((F.col("event_type") == kind).cast("int"))
    days = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), count("error").alias("errors"), count("purchase").alias("buys"))
    change = diff.first_last(days, ["user_id"], "day", ["n", "errors", "buys"])
    return change.select("user_id", diff.trend_class(F.col("d_n"), F.col("d_errors"), F.col("d_buys")).alias("trend"))


@query("""WITH p AS (SELECT toxic = 1 AS truth, regexp_matches(lower(text), '(^|[^a-z])(idiot|stupid|trash|loser|moron|clown|scum)([^a-z]|$)') AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT sum((truth AND said)::INT)::BIGINT AS tp, sum((NOT truth AND said)::INT)::BIGINT AS fp, sum((truth AND NOT said)::INT)::BIGINT AS fn FROM p)
SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 4) END AS recall FROM c""")
def labelled_precision_recall(t):
    said = F.lower("text").rlike("(^|[^a-z])(idiot|stupid|trash|loser|moron|clown|scum)([^a-z]|$)")
    rows = t("documents").join(t("labels"), "doc_id").select((F.col("toxic") == 1).alias("truth"), said.alias("said"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    tp, fp, fn = F.col("truth") & F.col("said"), ~F.col("truth") & F.col("said"), F.col("truth") & ~F.col("said")
    counts = rows.agg(n(tp).alias("tp"), n(fp).alias("fp"), n(fn).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.round(F.col("tp") / (F.col("tp") + F.col(other)), 4))
    return counts.withColumn("precision", share("fp")).withColumn("recall", share("fn"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS n FROM orders),
r(o_custkey, n, o_orderkey, cost, spare, taken) AS (SELECT o_custkey, n, o_orderkey, cost, CASE WHEN cost <= 500000 THEN 500000 - cost ELSE 500000 END, cost <= 500000 FROM o WHERE n = 1
UNION ALL SELECT o.o_custkey, o.n, o.o_orderkey, o.cost, CASE WHEN o.cost <= spare THEN spare - o.cost ELSE spare END, o.cost <= spare FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
SELECT o_custkey, o_orderkey, cost FROM r WHERE taken""")
def budget_first_fit(t):
    return folds.first_fit(t("orders"), "o_custkey", "o_totalprice", ["o_orderpriority", "o_totalprice", "o_orderkey"], 500_000, "o_orderkey")


@query(f"""WITH RECURSIVE {SQL_LINES_TABLE}, h AS ({_HITS}), k AS (SELECT doc_id, line_no, CASE rule_id WHEN 'LICENSE' THEN 4 WHEN 'TABLE' THEN 3 WHEN 'SHOUT' THEN 2 ELSE 1 END AS rank, CASE WHEN rule_id IN ('LICENSE', 'TABLE') THEN 'text' ELSE 'form' END AS tag FROM h),
o AS (SELECT doc_id, struct_pack(line_no := line_no, rank := rank, tag := tag) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY line_no * 10 - rank) AS n FROM k),
r(doc_id, n, kept) AS (SELECT doc_id, n, [x] FROM o WHERE n = 1 UNION ALL
  SELECT doc_id, n, CASE WHEN i IS NULL THEN list_append(kept, x) WHEN x.rank > kept[i].rank THEN list_concat(list_concat(kept[:i - 1], [x]), kept[i + 1:]) ELSE kept END
  FROM (SELECT o.doc_id, o.n, kept, x, list_filter(range(1, len(kept) + 1), lambda j: abs(kept[j].line_no - x.line_no) <= 2 AND kept[j].tag = x.tag)[1] AS i FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1)),
f AS (SELECT doc_id, unnest(arg_max(kept, n)) AS x FROM r GROUP BY 1)
SELECT doc_id, x.line_no::INT AS line_no, x.rank::INT AS rank, (x.line_no * 10 - x.rank)::INT AS ordinal FROM f""")
def overlap_dedupe(t):
    hits = rules.match_lines(lines_of(t), RULES)
    rank = risk.lookup({"LICENSE": 4, "TABLE": 3, "SHOUT": 2}, F.col("rule_id"), 1)
    tag = F.array(F.when(F.col("rule_id").isin("LICENSE", "TABLE"), "text").otherwise("form"))
    return folds.merge_near(hits.select("doc_id", "line_no", rank.alias("rank"), (F.col("line_no") * 10 - rank).alias("ordinal"), tag.alias("tags")), "doc_id", "line_no", "rank", "ordinal", tags="tags")


@query("""WITH s AS (SELECT conv_id, turn, role, 10 * CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END + least(10, greatest(1, length(text) // 50)) AS score FROM conversations)
SELECT conv_id, turn, role, score::INT AS score FROM s ORDER BY score DESC, conv_id, turn LIMIT 500""")
def suspicion_topk(t):
    score = 10 * risk.lookup({"user": 3, "assistant": 2}, F.col("role"), 1) + F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.length("text") / 50).cast("int")))
    return t("conversations").select("conv_id", "turn", "role", score.alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(500)


@query("SELECT user_id, event_type, max(ts) AS ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2")
def ttl_lookup(t):
    return diff.fresh(t("events"), ["user_id", "event_type"], "ts", 7)


@query(f"""WITH {SQL_LINES_TABLE}, s AS (SELECT doc_id, line_no, sum(length(line) - length(replace(line, '(', '')) - length(line) + length(replace(line, ')', ''))) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM l),
d AS (SELECT doc_id, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line_no)) AS d FROM s) SELECT doc_id, max(d)::BIGINT AS max_depth FROM d GROUP BY 1""")
def nesting_depth(t):
    braces = lines_of(t).withColumn("line", F.translate("line", "(){}", "{}"))
    return folds.nesting(braces, "doc_id").select("doc_id", F.col("max_depth").cast("long").alias("max_depth"))


def event_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a file stream, folded into counts by day and kind; the result is read back."""
    out, state = scratch_path(spark, "watch"), scratch_path(spark, "watch-state")
    schema = table(spark, sf_dir, "events").schema

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    watch(spark, sf_dir, schema, state, each, pattern="events.parquet").awaitTermination()
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


QUERIES["event_watch"] = event_watch
ORACLES["event_watch"] = "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
