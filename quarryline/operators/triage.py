"""What takes a finding back or lowers it: markers in the source, test files, context, neighbouring lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.intervals import smallest_enclosing
from quarryline.operators.joins import sized
from quarryline.operators.risk import lookup
from quarryline.session import materialize

# Folders and names of tests.
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__"]
TEST_PREFIXES = ["test_", "spec_"]
TEST_SUFFIXES = ["_test.go", "_test.py", "_test.java", "_test.js", "_test.ts", ".spec.js", ".spec.ts", ".test.js", ".test.ts"]
# Rules that do not count in tests, by engine.
TEST_EXEMPT = {
    "security": ["HARDCODED-PASSWORD", "SQL-INJECTION-RISK", "EVAL-USAGE", "WEAK-HASH", "INSECURE-RANDOM", "PATH-TRAVERSAL-RISK", "COMMAND-INJECTION-RISK", "UNSAFE-DESERIALIZATION", "WEAK-CIPHER", "INSECURE-TLS-VERIFICATION", "SSRF-RISK"],
    "performance": ["SQL-IN-LOOP", "MISSING-PAGINATION", "SELECT-STAR-NO-LIMIT"],
    "defect": ["PRINT-DEBUG", "ASSERT-USED", "DEAD-CODE"],
}
# Words in the name of a function that tell what its hashes and random numbers are for.
SECURITY_WORDS = ["password", "passwd", "pwd", "secret", "token", "session", "auth", "credential", "verify", "otp", "csrf", "salt"]
OTHER_WORDS = ["checksum", "etag", "cache", "fingerprint", "integrity", "digest", "sample", "shuffle", "jitter", "backoff", "pick"]
CONTEXT_RULES = ["WEAK-HASH", "INSECURE-RANDOM"]
LOWER = {"critical": "high", "high": "medium", "medium": "low", "low": "info"}
#: What a comment begins with to take findings back, as words in lower case.
MARKS = [["noqa"], ["audit:", "ignore"]]
COMMENT_SIGNS = "#|//"


def is_test_file(path: Column) -> Column:
    """In a folder of tests, or named as one; null is not."""
    parts = F.split(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    named = F.lit(False)
    for prefix in TEST_PREFIXES:
        named |= name.startswith(prefix)
    for suffix in TEST_SUFFIXES:
        named |= name.endswith(suffix)
    return F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | named


def counts_here(rule: Column, path: Column) -> Column:
    """Not one of the rules that do not count in a test file."""
    exempt = [r for rules in TEST_EXEMPT.values() for r in rules]
    return ~(rule.isin(exempt) & is_test_file(path))


def taken_back(line: Column, marks: list[list[str]] = MARKS, signs: str = COMMENT_SIGNS) -> Column:
    """The rule ids, in upper case, that a comment of the line takes back; ``*`` alone for a mark without ids; null without a mark.

    A line is cut at its comment signs. A comment is a mark if its first words
    are (an empty mark is any comment); ids are the words after it, parted by
    blanks or commas, up to the first that is none, of which the part counts that
    could be one. A colon may stand between.
    """

    def ids(comment: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.lower(comment), ":", ": "), r"[\s,]+"), lambda w: w != "")
        found = F.lit(None).cast("array<string>")
        for mark in marks:
            for spelled in (mark, [*mark[:-1], mark[-1] + ":"]) if mark else ([],):
                after = F.slice(words, len(spelled) + 1, F.size(words) + 1)
                opens = F.slice(words, 1, len(spelled)) == F.array(*map(F.lit, spelled)) if spelled else F.lit(True)
                found = F.coalesce(found, F.when(opens, after))
        return found

    def known(words: Column) -> Column:
        end = F.array_position(F.transform(words, lambda w: w.rlike(r"^[a-z0-9_-]+$")), F.lit(False))
        own = F.when(end > 0, F.slice(words, F.lit(1), end.cast("int"))).otherwise(words)
        own = F.filter(F.transform(own, lambda w: F.upper(F.regexp_extract(w, r"^[a-z0-9_-]*", 0))), lambda w: w != "")
        return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("*")))

    comments = F.split(line, signs)
    marked = F.array_compact(F.transform(F.slice(comments, F.lit(2), F.size(comments)), ids))
    return F.when(F.size(marked) > 0, known(marked[0]))


def suppressions(lines: DataFrame, marks: list[list[str]] = MARKS, signs: str = COMMENT_SIGNS) -> DataFrame:
    """``path, line_no, rule_id``: what a marker takes back on its own line and the one below; a marker without ids: ``*``."""
    marked = lines.where(F.col("line").rlike(signs)).select("path", "line_no", F.explode(taken_back(F.col("line"), marks, signs)).alias("rule_id"))
    return marked.select("path", F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line_no"), "rule_id").distinct()


def not_suppressed(hits: DataFrame, lines: DataFrame, marks: list[list[str]] = MARKS, signs: str = COMMENT_SIGNS) -> DataFrame:
    """The hits ``path, rule_id, line_no`` that no marker on their line or the one above takes back; ids compare in upper case."""
    back = suppressions(lines, marks, signs).groupBy("path", "line_no").agg(F.collect_set("rule_id").alias("taken"))  # a line's few ids
    both = hits.join(back, ["path", "line_no"], "left")
    gone = F.array_contains("taken", "*") | F.array_contains("taken", F.upper("rule_id"))
    return both.where(~F.coalesce(gone, F.lit(False))).select(hits.columns)


def security_context(name: Column) -> Column:
    """A function whose name has a word of security, or none that says otherwise; null is no function."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.rlike("|".join(SECURITY_WORDS)) | ~low.rlike("|".join(OTHER_WORDS))


def in_context(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits of weak hashes and random numbers only where the innermost function around them may be about security; all other hits."""
    spans = blocks.where("kind = 'function'").select("path", "name", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    asked = hits.where(F.col("rule_id").isin(CONTEXT_RULES)).select("path", "line_no").distinct()
    asked = materialize(asked.withColumn("_place", F.struct("path", "line_no")), "asked")
    inner = smallest_enclosing(asked, spans, ["path"], "line_no", "_place", carry=("name",))
    named = sized(inner.select("_place.path", "_place.line_no", F.col("name").alias("function")), asked.count())
    found = hits.join(named, ["path", "line_no"], "left")
    return found.where(~F.col("rule_id").isin(CONTEXT_RULES) | security_context(F.col("function"))).select(hits.columns)


#: Reason, rules, lines before and after the hit that are read, what they have.
VALIDATORS: list[tuple[str, list[str], int, int, str]] = [
    ("null is tested", ["POSSIBLE-NONE-DEREF", "NULL-PROP-UNCHECKED", "NULLABLE-VALUE-USE"], 5, 5, r"(?:is\s+not\s+None|[!=]=+\s*(?:null|nil|None|undefined)|requireNonNull|Optional\b|\?\.|if\s+\w+\s*:)"),
    ("resource lives long", ["RESOURCE-LEAK", "RESOURCE-CLOSE-NOT-GUARANTEED"], 5, 1, r"(?i)\bstatic\b|singleton|\bpool|@Bean|self\.\w+\s*=|this\.\w+\s*="),
    ("resource is closed", ["RESOURCE-LEAK", "RESOURCE-CLOSE-NOT-GUARANTEED"], 0, 20, r"(?i)\.close\s*\(|\bfclose\b|\bdefer\b|\bfinally\b|\bwith\s"),
    ("fails at once", ["BROAD-EXCEPT", "BARE-EXCEPT", "SINGLETON-INIT"], 0, 6, r"\braise\b|\bthrow\b|\bpanic\s*\(|\bsys\.exit|\bos\.Exit|System\.exit"),
    ("loop is meant to run", ["INFINITE-LOOP-RISK", "BUSY-WAIT"], 3, 10, r"(?i)accept\s*\(|consume|poll\s*\(|\bsleep|select\b|event_?loop|\bserve|\bawait\b"),
    ("value is cleaned", ["SQL-INJECTION-RISK", "COMMAND-INJECTION-RISK", "PATH-TRAVERSAL-RISK", "SSRF-RISK", "CSV-INJECTION"], 10, 0, r"(?i)escape|sanitiz|quote\s*\(|prepare|setString|allow_?list|secure_filename|normalize"),
    ("exception is handled", ["EMPTY-EXCEPT", "LOG-ONLY-EXCEPT", "SWALLOWED-EXCEPTION-FLOW", "EXCEPTION-SWALLOWED-NO-LOG"], 0, 8, r"(?i)retry|fallback|\bmetrics?\b|\braise\b|\bthrow\b|compensat|alert"),
]


def likely_false(hits: DataFrame, lines: DataFrame, quoted: Column | None = None) -> DataFrame:
    """``path, rule_id, line_no, reason`` of the hits that neighbouring lines speak against, the first reason of ``VALIDATORS``' order.

    ``quoted`` is a name that the finding quotes: where none of the lines within
    five has it, the finding is about something else; that is the first reason.
    Hits are exploded to the lines that they look at: an equality join.
    """
    reach = max(max(v[2], v[3]) for v in VALIDATORS)
    wanted = hits.select("path", "rule_id", "line_no", (quoted if quoted is not None else F.lit(None).cast("string")).alias("quoted"), F.explode(F.sequence(-F.lit(reach), F.lit(reach))).alias("off"))
    near = wanted.withColumn("at", F.col("line_no") + F.col("off")).join(lines.select("path", F.col("line_no").alias("at"), "line"), ["path", "at"])
    seen = [F.max(F.when(F.col("rule_id").isin(rules) & F.col("off").between(-before, after), F.col("line").rlike(pattern))).alias(f"v{i}") for i, (_, rules, before, after, pattern) in enumerate(VALIDATORS)]
    quoted_near = F.max(F.when(F.col("off").between(-5, 5) & F.col("quoted").isNotNull(), F.contains("line", F.col("quoted")))).alias("named")
    facts = near.groupBy("path", "rule_id", "line_no").agg(quoted_near, *seen)
    reason = F.when(~F.col("named"), "its name is not there")
    for i, (why, *_) in enumerate(VALIDATORS):
        reason = reason.when(F.col(f"v{i}"), why)
    return facts.select("path", "rule_id", "line_no", reason.alias("reason")).where("reason is not null")


def lowered(findings: DataFrame, doubtful: DataFrame, engine: str) -> DataFrame:
    """Security findings of an engine that are doubtful (``path, rule_id, line_no``) one grade lower, not blocking, and marked; none is dropped."""
    marks = doubtful.select("path", "rule_id", "line_no").distinct().withColumn("_doubt", F.lit(True))
    rows = findings.join(marks, ["path", "rule_id", "line_no"], "left")
    hit = F.coalesce(F.col("_doubt"), F.lit(False)) & (F.col("engine") == engine) & (F.col("category") == "security")
    out = rows.withColumn("tags", F.when(hit, F.array_append("tags", F.lit("likely-fp"))).otherwise(F.col("tags")))
    out = out.withColumn("blocks", F.col("blocks") & ~hit).withColumn("evidence_level", F.when(hit, "needs-review").otherwise(F.col("evidence_level")))
    return out.withColumn("severity", F.when(hit, lookup(LOWER, F.col("severity"), "info")).otherwise(F.col("severity"))).select(findings.columns)


def numbered(rows: DataFrame, order: list, number: str = "number") -> DataFrame:
    """The rows with their place, from 1, in a full order of all of them.

    Rows are dealt by ranges of the order and counted there; the ranges' sizes,
    a row a range, give each range its first number. No range meets another.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row a range
    first, total = {}, 0
    for r in sorted(sizes):
        first[r], total = total, total + sizes[r]
    if not first:
        return rows.withColumn(number, F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("_range"))
    return dealt.withColumn(number, start + F.col("_at") + 1).drop("_range", "_at")


def finding_ids(hits: DataFrame, engine: str, prefix: str, order: list) -> DataFrame:
    """Hits with ``id``: prefix and number in scan order, three digits at least, and their ``engine``."""
    out = numbered(hits, order, "_number")
    padded = F.when(F.col("_number") < 1000, F.lpad(F.col("_number").cast("string"), 3, "0")).otherwise(F.col("_number").cast("string"))
    return out.withColumn("id", F.concat(F.lit(prefix + "-"), padded)).withColumn("engine", F.lit(engine)).drop("_number")
