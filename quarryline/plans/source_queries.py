"""Sources and sinks on the driver's tables: rows are written in a format to the scratch folder and read back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import diff, findings
from quarryline.plans.code_queries import values
from quarryline.plans.score_queries import SQL_PAGES, pages_as_findings
from quarryline.session import scratch_path
from quarryline.sinks import reports
from quarryline.sinks.bucket_cache import BucketCache
from quarryline.sources import coverage, files, history, tree
from quarryline.sources import findings as elsewhere
from quarryline.sources.tables import table
from quarryline.streaming import states, watch

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


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in the scratch folder, whatever store that is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


_HISTORY = """c AS (SELECT user_id % 20 AS author, event_id % 300 AS commit, event_type AS path, trunc(value)::BIGINT AS added, user_id % 7 AS deleted FROM events),
o AS (SELECT path, author, commit, sum(added + deleted) AS n FROM c GROUP BY ALL), a AS (SELECT path, author, count(*) AS commits, sum(n) AS n FROM o GROUP BY 1, 2)"""


@query(f"""WITH {_HISTORY} SELECT path, sum(n)::BIGINT AS changed, sum(commits)::BIGINT AS commits, count(*) AS authors, arg_min(author || '@x', (-commits, author || '@x')) AS top_author, round(max(commits) / sum(commits), 3) AS top_share FROM a GROUP BY 1""")
def change_log_rows(t):
    """Events as the rows of a log of changes, ten of a commit; kinds of events are the files."""
    events = t("events")
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "log")
    head = F.concat(F.lit("@@"), (F.col("event_id") % 300).cast("string"), F.lit("|"), (F.col("user_id") % 20).cast("string"), F.lit("@x|"), (F.col("event_id") * 60).cast("string"))
    row = F.concat_ws("\t", F.col("value").cast("long").cast("string"), (F.col("user_id") % 7).cast("string"), "event_type")
    events.select(F.concat(head, F.lit("\n\n"), row).alias("value")).write.text(path)
    return history.file_history(history.change_log(spark, path, "@@"))


@query("""WITH h AS (SELECT c_custkey, c_custkey % 5 + 1 AS n, c_custkey * 10 AS start FROM customer) SELECT 'src/c' || c_custkey || '.py' AS path, unnest(range(start, start + n))::INT AS line_no FROM h WHERE c_custkey % 6 > 0""")
def changed_lines(t):
    """A diff of one file a customer; every sixth only takes lines away."""
    rows = t("customer")
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "diff")
    name = F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(".py"))
    n = F.when(F.col("c_custkey") % 6 == 0, 0).otherwise(F.col("c_custkey") % 5 + 1)
    hunk = F.concat(F.lit("@@ -3,2 +"), (F.col("c_custkey") * 10).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@ def f"))
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), hunk, F.lit("\n+x"))
    rows.select(text.alias("value")).write.text(path)
    return history.changed_lines(spark, path).select("path", "line_no")


_NAMES = ["A\ta.py", "M\tsrc\\b.py", "D\tgone.py", "R100\told.py\tnew.py", "C75\tfrom.py\tto.py", "T\tkind.py", "", "M\ta.py"]


@query("SELECT * FROM (VALUES ('a.py', 'A'), ('a.py', 'M'), ('src/b.py', 'M'), ('new.py', 'R'), ('to.py', 'C')) x(path, status)")
def changed_names(t):
    spark = t("region").sparkSession
    path = scratch_path(spark, "names")
    put(spark, f"{path}/names.txt", "\n".join(_NAMES).encode())
    return history.changed_names(spark, path)


_REPORTS = """s AS (SELECT n_regionkey AS r, 'f' || s_suppkey % 40 AS path, s_suppkey, s_suppkey % 9 + 1 AS total, s_suppkey % 4 AS missing FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY r, path ORDER BY s_suppkey) = 1), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY path ORDER BY r DESC) = 1)"""


@query(f"WITH {_REPORTS} SELECT path, greatest(total - least(missing, total), 0)::INT AS covered_lines, total::INT AS total_lines, least(missing, total)::INT AS missing FROM l")
def coverage_reports(t):
    """A report a region with a file a supplier; of reports that know a file the last counts."""
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "coverage")
    total, missing = (F.col("s_suppkey") % 9 + 1).cast("int"), F.least((F.col("s_suppkey") % 4).cast("int"), (F.col("s_suppkey") % 9 + 1).cast("int"))
    name = F.concat(F.lit("f"), (F.col("s_suppkey") % 40).cast("string"))
    first = rows.groupBy(F.col("n_regionkey").alias("r"), name.alias("path")).agg(F.min_by(F.struct(total.alias("total"), missing.alias("missing")), "s_suppkey").alias("v"))
    numbers = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    entry = F.struct(numbers(F.lit(1), F.col("v.total") - F.col("v.missing")).alias("executed_lines"), numbers(F.col("v.total") - F.col("v.missing") + 1, F.col("v.total")).alias("missing_lines"), F.struct((F.col("v.total") - F.col("v.missing")).alias("covered_lines"), F.col("v.total").alias("num_statements")).alias("summary"))
    each = first.select("r", "path", entry.alias("e")).groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("path", "e"))).alias("files"))
    each.select("r", F.to_json(F.struct("files")).alias("value")).write.partitionBy("r").text(path)
    latest = coverage.latest(coverage.json_reports(spark, f"{path}/*/*.txt"))
    return latest.select("path", "covered_lines", "total_lines", F.size("missing").alias("missing"))


@query(f"WITH {_REPORTS} SELECT round(100.0 * sum(total - least(missing, total)) / sum(total), 1) AS lines, NULL::DOUBLE AS branches, round(100.0 * sum((missing < total)::INT) / count(*), 1) AS functions FROM d")
def xml_coverage(t):
    """Each region's suppliers as the classes of an XML report of its own, with a root as the reader wants it."""
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "xml")
    total, missing = (F.col("s_suppkey") % 9 + 1).cast("int"), F.least((F.col("s_suppkey") % 4).cast("int"), (F.col("s_suppkey") % 9 + 1).cast("int"))
    first = rows.groupBy("n_regionkey", (F.col("s_suppkey") % 40).alias("f")).agg(F.min_by(F.struct(total.alias("total"), missing.alias("missing")), "s_suppkey").alias("v"))
    line = lambda i: F.concat(F.lit('<line number="'), i.cast("string"), F.lit('" hits="'), F.when(i <= F.col("v.total") - F.col("v.missing"), "2").otherwise("0"), F.lit('"/>'))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.col("v.total")), line), "")
    rate = F.when(F.col("v.missing") < F.col("v.total"), "0.5").otherwise("0")
    text = F.concat(F.lit('<class filename="f'), F.col("f").cast("string"), F.lit('"><methods><method name="m" line-rate="'), rate, F.lit('"/></methods><lines>'), lines, F.lit("</lines></class>"))
    report = F.concat(F.lit("<coverage><packages><package><classes>"), F.array_join(F.collect_list(text), ""), F.lit("</classes></package></packages></coverage>"))
    first.groupBy("n_regionkey").agg(report.alias("value")).write.partitionBy("n_regionkey").text(path)  # at most 40 classes a report
    return coverage.totals(coverage.xml_reports(spark, f"{path}/*/*.txt"))


@query("""WITH c AS (SELECT c_custkey, c_custkey * 10 AS p, c_custkey % 5 + 1 AS n, c_nationkey FROM customer), k AS (SELECT c_custkey, unnest(range(p - 2, p + 2)) AS line, true AS hit FROM c UNION ALL SELECT c_custkey, unnest(range(p + 1, p + 1 + c_nationkey % 4)), false FROM c),
h AS (SELECT c_custkey, line, bool_or(hit) AS hit FROM k GROUP BY 1, 2), d AS (SELECT c_custkey, unnest(range(p, p + n)) AS line FROM c WHERE c_custkey % 6 > 0)
SELECT sum(hit::INT)::BIGINT AS covered, count(*) AS total, round(100.0 * sum(hit::INT) / count(*), 1) AS percent FROM d JOIN h USING (c_custkey, line)""")
def changed_line_coverage(t):
    """Of the lines that a change of customers' files touches, how many a report knows as executed."""
    rows = t("customer")
    at, path = (F.col("c_custkey") * 10).cast("int"), F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(".py"))
    missed = F.slice(F.sequence(at + 1, at + 3), F.lit(1), (F.col("c_nationkey") % 4).cast("int"))
    report = rows.select(path.alias("path"), F.sequence(at - 2, at + 1).alias("executed"), missed.alias("missing"))
    changed = rows.where("c_custkey % 6 > 0").select(path.alias("path"), F.explode(F.sequence(at, at + (F.col("c_custkey") % 5).cast("int"))).alias("line_no"))
    return coverage.changed_coverage(report, changed)


@query("SELECT event_type || ':' || user_id AS key, max(event_id) AS made, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def bucketed_cache(t):
    """Events as entries of a cache by kind and user: all of them, then those of the dearest anew, of which only the buckets are written."""
    rows = t("events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("made"), "value")
    spark = rows.sparkSession
    cache = BucketCache(spark, scratch_path(spark, "bucket-cache"), rows.schema, "key", "made")
    cache.update(rows)
    cache.update(rows.orderBy(F.desc("value"), "made").limit(5))
    return cache.read()


@query("""WITH k AS (SELECT DISTINCT o_orderpriority || '::' || o_custkey || '::' || o_orderkey % 50 || '::' || o_orderkey % 50 AS s FROM orders WHERE o_orderkey % 3 > 0)
SELECT o_orderkey FROM orders WHERE o_orderpriority || '::' || o_custkey || '::' || o_orderkey % 50 || '::' || o_orderkey % 50 NOT IN (SELECT s FROM k)""")
def baseline_file(t):
    """Orders as findings; two thirds are in a baseline, half of them as a list, half as an object."""
    orders = t("orders")
    spark, path = orders.sparkSession, scratch_path(orders.sparkSession, "baseline")
    line = (F.col("o_orderkey") % 50).cast("int")
    place = F.struct(F.col("o_custkey").cast("string").alias("file_path"), line.alias("line_start"))
    rows = orders.where("o_orderkey % 3 > 0").groupBy((F.col("o_orderkey") % 8).alias("part")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("rule_id"), place.alias("location"))).alias("findings"))
    text = F.when(F.col("part") % 2 == 0, F.to_json("findings")).otherwise(F.to_json(F.struct("findings")))
    rows.select("part", text.alias("value")).write.partitionBy("part").text(path)
    put(spark, f"{path}/part=9/broken.txt", b'{"findings": [')
    known = elsewhere.baseline(spark, f"{path}/*/*.txt")
    mine = orders.select("o_orderkey", elsewhere.signature(F.col("o_orderpriority"), F.col("o_custkey").cast("string"), line, F.lit(None).cast("int")).alias("signature"))
    return diff.beyond_baseline(mine, known, ["signature"]).select("o_orderkey")


@query("""SELECT 'rule.' || p_size AS rule_id, 'src/' || p_partkey || '.py' AS path, p_size AS line_no, CASE p_type WHEN 'SMALL' THEN 'high' WHEN 'PROMO' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN p_size % 2 = 0 THEN 'defect' ELSE 'security' END AS category, CASE WHEN p_size % 3 = 0 THEN 'CWE-611' ELSE '' END AS cwe_ids FROM part""")
def scanner_rows(t):
    """Parts as the results of another scanner's reports."""
    part = t("part")
    spark, path = part.sparkSession, scratch_path(part.sparkSession, "scanner")
    grade = F.when(F.col("p_type") == "SMALL", "ERROR").when(F.col("p_type") == "PROMO", "INFO").otherwise("odd")
    cwe = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("CWE-611: text"), F.lit("cwe-611"))).otherwise(F.array().cast("array<string>"))
    meta = F.struct(F.when(F.col("p_size") % 2 == 0, "correctness").alias("category"), cwe.alias("cwe"))
    result = F.struct(F.concat(F.lit("rule."), F.col("p_size").cast("string")).alias("check_id"), F.concat(F.lit("/repo/src/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.struct(F.col("p_size").alias("line")).alias("start"), F.struct(F.lit("said").alias("message"), grade.alias("severity"), meta.alias("metadata")).alias("extra"))
    rows = part.groupBy((F.col("p_partkey") % 8).alias("part")).agg(F.collect_list(result).alias("results"))
    rows.select("part", F.to_json(F.struct("results")).alias("value")).write.partitionBy("part").text(path)
    found = elsewhere.scanner_report(spark, f"{path}/*/*.txt", "/repo")
    return found.select("rule_id", "path", "line_no", "severity", "category", F.array_join("cwe_ids", ",").alias("cwe_ids"))


_TREE = {
    "a.py": b"x = 1\n",
    "src/b.GO": b"package b\n",
    "src/odd.py": b"\xc3\xa4\xff \xef\xbf\xbd\n",
    "src/made.py": b"# This file is @generated, so leave it\n",
    "src/api_pb2.py": b"y = 1\n",
    "src/bin.py": b"\x7fELF...",
    "src/nul.py": b"a\0b",
    "node_modules/x.js": b"1",
    ".github/ci.py": b"z = 1\n",
    ".secret/x.py": b"z = 1\n",
    "logs/y.py": b"z = 1\n",
    "skip/me.py": b"z = 1\n",
    "notes.md": b"# x",
    ".gitignore": b"# rules\nlogs/\n!a.py\n",
}
_SCANNED = [("a.py", "python", "x = 1"), ("src/b.GO", "go", "package b"), ("src/odd.py", "python", "ä �"), (".github/ci.py", "python", "z = 1")]


@query(f"SELECT path, lang, content || chr(10) AS content FROM {values(_SCANNED)} e(path, lang, content)")
def file_scan(t):
    """A small tree: skipped, ignored, generated and binary files are left out."""
    spark = t("region").sparkSession
    root = scratch_path(spark, "tree")
    for name, content in _TREE.items():
        put(spark, f"{root}/{name}", content)
    return files.scan(spark, root, exclude=["skip/*"], ignore_rules=files.ignore_rules(spark, root), only=["python", "go"])


@query("SELECT * FROM (VALUES ('a.py', 'changed'), ('new.py', 'added')) x(path, state)")
def watched_changes(t):
    """Two listings of a folder: one file was written anew, one came, one went, one stayed."""
    spark = t("region").sparkSession
    root = scratch_path(spark, "watched")
    for name in ("a.py", "gone.py", "same.py"):
        put(spark, f"{root}/{name}", b"x")
    before = spark.createDataFrame(watch.file_listing(spark, root).collect(), "path string, modified timestamp, length long")
    put(spark, f"{root}/a.py", b"longer")
    put(spark, f"{root}/new.py", b"x")
    now = watch.file_listing(spark, root).where(~F.col("path").endswith("gone.py"))
    return watch.changes(before, now).select(F.element_at(F.split("path", "/"), -1).alias("path"), "state")


@query(f"""WITH {SQL_PAGES} SELECT rule_id, category, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM p GROUP BY ALL""")
def sarif_results(t):
    """Pages as findings, written as SARIF and read back."""
    rows = pages_as_findings(t).select(F.col("page_id").alias("ordinal"), "rule_id", F.col("words").alias("title"), "severity", "confidence", "category", "path", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), "blocks")
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "sarif")
    reports.write_sarif(rows, path, "quarryline")
    kind = "struct<runs:array<struct<results:array<struct<ruleId:string,level:string,properties:struct<category:string>>>>>>"
    found = spark.read.text(path).select(F.explode(F.from_json("value", kind)["runs"]).alias("run")).select(F.explode("run.results").alias("r"))
    return found.groupBy(F.col("r.ruleId").alias("rule_id"), F.col("r.properties.category").alias("category"), F.col("r.level").alias("level")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT p_brand AS key, p_partkey AS made, p_size AS value FROM part) SELECT key, max(made) AS made, arg_max(value, made) AS value FROM k GROUP BY 1""")
def cache_versions(t):
    """Three updates of a cache by hash; the newest entry of each key stays."""
    rows = t("part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("made"), F.col("p_size").alias("value"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "cache")
    for i in (1, 2, 0):
        reports.update_cache(spark, path, rows.where(F.col("made") % 3 == i).groupBy("key").agg(F.max("made").alias("made"), F.max_by("value", "made").alias("value")).select("key", "made", "value"), "key", "made")
    return reports.read_cache(spark, path)


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, max(ts) AS made FROM events GROUP BY 1, 2), n AS (SELECT day, max(made) AS made FROM d GROUP BY 1 ORDER BY made DESC, day DESC LIMIT 5) SELECT day::VARCHAR AS scan, count(*) AS n FROM d JOIN n USING (day) GROUP BY 1""")
def newest_snapshots(t):
    """A snapshot a day; the five newest are read back."""
    rows = t("events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max("ts").alias("at"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "snapshots")
    rows.withColumnRenamed("day", "scan_id").write.partitionBy("scan_id").parquet(path)
    held = reports.read_snapshots(spark, path).withColumn("scan_id", F.col("scan_id").cast("string"))
    first = elsewhere.newest(held, "scan_id", "at", 5)
    return held.join(F.broadcast(first.select("scan_id")), "scan_id").groupBy(F.col("scan_id").alias("scan")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 50 END::INT AS line_no FROM customer WHERE (c_custkey % 4 = 0 AND c_nationkey % 3 = 0) OR (c_custkey % 4 > 0 AND c_nationkey % 3 = 0 AND c_custkey % 50 < 25)""")
def incremental_findings(t):
    """Customers as findings in their nation's file; of each third nation the first 25 lines have changed."""
    line = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_custkey") % 50).cast("int")
    rows = t("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("path"), line.alias("line_no"))
    changed = t("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("line_no"))
    return history.incremental(rows, changed).select("c_custkey", "line_no")


@query("""WITH f AS (SELECT p_partkey, ['src/a.py', 'project', 'src/b.py', ''][p_partkey % 4 + 1] AS path FROM part) SELECT path, count(*) AS n FROM f WHERE path <> 'src/b.py' GROUP BY 1""")
def changed_file_findings(t):
    path = F.element_at(F.array(*map(F.lit, ["src/a.py", "project", "src/b.py", ""])), (F.col("p_partkey") % 4).cast("int") + 1)
    rows = t("part").select("p_partkey", path.alias("path"))
    changed = rows.sparkSession.createDataFrame([("src/a.py",), ("src/c.py",)], "path string")
    return findings.in_changed_files(rows, changed).groupBy("path").agg(F.count("*").alias("n"))


# Documents as files of one tree: by source in a folder, some of which are skipped, and by language and length under a name.
_FOLDERS = ["src", "src/core", "lib", "node_modules/left", "app/.hidden", ".github/tools", "app/node_modules", "pkg2", "api", "docs"]
_ENDINGS = {"en": "py", "de": "go", "fr": "java", "es": "png"}
SQL_TREE = f"""tr AS (SELECT CASE (length(source) + doc_id) % {len(_FOLDERS)} {" ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS))} END AS folder,
  'doc' || doc_id || CASE WHEN n_chars % 7 = 0 THEN '_pb2' ELSE '' END || CASE lang {" ".join(f"WHEN '{k}' THEN '.{v}'" for k, v in _ENDINGS.items())} ELSE '.x' END AS name, coalesce(text, '') AS text FROM documents)"""


def _written_tree(t) -> tuple:
    """Writes the documents as files, in the cluster, below a new scratch folder; gives the session and the folder."""
    docs = t("documents")
    spark = docs.sparkSession
    root = scratch_path(spark, "tree")
    place = (F.length("source") + F.col("doc_id")) % len(_FOLDERS)
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), place.cast("int") + 1)
    ending = F.coalesce(F.create_map(*[F.lit(x) for k, v in _ENDINGS.items() for x in (k, "." + v)])[F.col("lang")], F.lit(".x"))
    name = F.concat(folder, F.lit("/doc"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") % 7 == 0, "_pb2").otherwise(""), ending)
    rows = docs.select(name.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    local = root.removeprefix("file://").removeprefix("file:")

    def write(batches):
        for batch in batches:
            for path, text in zip(*batch.columns, strict=True):  # one text at a time, from the batch's own memory
                at = os.path.join(local, path.as_py())
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(text.as_buffer() or b"")
            yield batch.slice(0, 0)

    rows.mapInArrow(write, "path string, text string").write.format("noop").mode("overwrite").save()
    return spark, root


@query(f"WITH {SQL_TREE} SELECT folder || '/' || name AS path, 'python' AS lang, strlen(text) AS bytes, sha256(text) AS digest FROM tr WHERE folder IN ('src', 'src/core', 'lib', '.github/tools', 'pkg2', 'api') AND name LIKE '%.py' AND name NOT LIKE '%_pb2.py' UNION ALL SELECT folder || '/' || name, 'go', strlen(text), sha256(text) FROM tr WHERE folder IN ('src', 'src/core', 'lib', '.github/tools', 'pkg2', 'api') AND name LIKE '%.go'")
def tree_scan(t):
    """The documents as a file tree, read again by the source for trees: skipped folders stay closed, two languages are asked for."""
    spark, root = _written_tree(t)
    rows = tree.scan(spark, root, only=["python", "go"])
    return rows.select("path", "lang", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query(f"WITH {SQL_TREE} SELECT folder || '/' || name AS path, strlen(text) AS size FROM tr WHERE folder IN ('src', 'src/core') AND name LIKE '%.java' AND strlen(text) BETWEEN 200 AND 4999")
def tree_names(t):
    """Names and sizes of files of one language below a folder, within bounds of size; no file is opened."""
    spark, root = _written_tree(t)
    rows = tree.tree(spark, root, content=False)
    return rows.where(F.col("path").startswith("src/") & (F.col("lang") == "java") & (F.col("size") >= 200) & (F.col("size") < 5000)).select("path", "size")


@query("""WITH s AS (SELECT event_type || '/' || user_id AS path, (value::BIGINT // 8)::VARCHAR AS digest, ts, event_id FROM events),
p AS (SELECT *, lag(digest) OVER w AS was, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY path ORDER BY ts, digest))
SELECT path, CASE n WHEN 1 THEN 'added' ELSE 'changed' END AS state, digest, ts AS at FROM p WHERE n = 1 OR digest <> was""")
def file_states(t):
    """Events as sights of files by kind and user, as a stream with state: each file once as added, then whenever its digest changes."""
    events = t("events")
    spark = events.sparkSession
    folder = scratch_path(spark, "sights")
    digest = F.floor(F.round("value") / 8).cast("string")
    rows = events.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), digest.alias("digest"), F.col("ts").cast("timestamp").alias("at"))
    rows.write.parquet(f"{folder}/in")
    sights = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    states.run(states.file_states(sights, expire_seconds=10**8), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(states.OUT).parquet(f"{folder}/out")
