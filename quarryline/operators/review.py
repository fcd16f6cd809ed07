"""Around a model's review of code: what it is shown, what it says, and what becomes of its findings.

No model is called here. ``answers`` takes any function from a prompt to a text;
the rest works on tables of what has been said.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import scan
from quarryline.operators.findings import json_of, nearest_match, verdict_of
from quarryline.operators.risk import lookup
from quarryline.session import materialize

# Thresholds and names.
FILE_LINES, CLASS_LINES = 300, 200
SKIPPED = ["*/generated/*", "*/gen/*", "*_generated.*", "*.pb.go", "*/migrations/*", "*/vendor/*", "vendor/*", "*/node_modules/*", "node_modules/*", "*/third_party/*", "third_party/*", "*/build/*", "*/dist/*", "*/target/*", "*.json", "*.xml", "*.yaml", "*.yml", "*.toml", "*.properties", "*.ini", "*.cfg", "*/test/*", "*/tests/*", "*_test.*", "*_spec.*", "*/testdata/*", "*/fixtures/*"]
GENERATED_MARKS = ["// Code generated", "// AUTO-GENERATED", "@Generated", "# This file is auto-generated", "# DO NOT EDIT", "/* Auto-generated"]
TRIVIAL_NAMES = ["get", "set", "is", "has", "to_string", "toString", "equals", "hashCode", "__repr__", "__str__", "__eq__", "__hash__"]
LOW_VALUE = ["maintainability", "architecture"]
CATEGORIES = {"security": "security", "null_safety": "defect", "logic": "defect", "resource": "performance", "error_handling": "defect", "performance": "performance"}
URGENT_CATEGORIES = ["security", "logic", "error_handling"]
SEVERITY_POINTS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SECOND_PASS_RULES = ["STATIC-MUTABLE-SHARED-STATE", "UNUSED-VARIABLE", "LOG-ONLY-EXCEPT", "SWALLOWED-EXCEPTION-FLOW", "BROAD-EXCEPT", "BARE-EXCEPT", "EXCEPTION-SWALLOWED-NO-LOG", "RESOURCE-LEAK", "RESOURCE-CLOSE-NOT-GUARANTEED"]
#: Words of a report that names the failure, and a call whose result is used at once.
FAILURE_WORDS = ["npe", "nullpointer", "nullpointerexception", "nonetype", "dereference", "dereferenced", "dereferences", "crash", "crashes", "segfault"]
FAILURE_PHRASES = ["null pointer", "nil pointer", "nil dereference", "cannot read propert"]
USED_AT_ONCE = r"\w\s*\([^()]*\)\s*(?:\.|->)\s*\w"
FINDINGS = "findings array<struct<title:string,category:string,severity:string,confidence:int,line_start:int,line_end:int,description:string,evidence:string>>"


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def skip_file(path: Column) -> Column:
    """A path that is not shown: generated, vendored, configuration, tests."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return _any([clean.rlike("^(?:" + fnmatch.translate(p) + ")") for p in SKIPPED])


def skip_content(text: Column) -> Column:
    """A generator's mark in the first ten lines."""
    head = F.substring_index(text, "\n", 10)
    return _any([F.contains(head, F.lit(m)) for m in GENERATED_MARKS])


def skip_function(name: Column, lines: Column, complexity: Column) -> Column:
    """At most five lines without a branch and named as an accessor, or at most three."""
    named = _any([name.startswith(p) | name.endswith(p) for p in TRIVIAL_NAMES])
    return (lines <= 5) & (complexity <= 1) & (named | (lines <= 3))


def chunks(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """``path, kind, name, line_start, line_end, loc, complexity`` of the pieces of ``path, content`` that are shown.

    A file of at most 300 lines is one. Of a longer one: classes of at most 200
    lines, the methods of larger ones, and functions outside classes that are not
    trivial. Skipped and blank files have none.
    """
    shown = files.where(~skip_file(F.col("path")) & ~skip_content(F.col("content")) & F.col("content").rlike(r"\S"))
    sized = shown.select("path", (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    loc = F.col("end_line") - F.col("start_line") + 1
    inside = materialize(blocks.join(sized.where(F.col("lines") > FILE_LINES).select("path"), "path", "left_semi").withColumn("loc", loc), "blocks")  # read four times below
    columns = ["path", "name", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "loc", "complexity"]
    top = inside.where("kind = 'class' and owner = ''")
    whole = top.where(F.col("loc") <= CLASS_LINES).select(F.lit("class").alias("kind"), *columns)
    large = top.where(F.col("loc") > CLASS_LINES).select("path", F.col("name").alias("owner"))
    functions = inside.where("kind = 'function'")
    methods = functions.join(large.distinct(), ["path", "owner"], "left_semi").select(F.lit("function").alias("kind"), "path", F.concat_ws(".", "owner", "name").alias("name"), *columns[2:])
    free = functions.where("owner = ''").where(~skip_function(F.col("name"), F.col("loc"), F.lit(0))).select(F.lit("function").alias("kind"), *columns)
    small = sized.where(F.col("lines") <= FILE_LINES).select(F.lit("file").alias("kind"), "path", F.lit("").alias("name"), F.lit(1).alias("line_start"), F.col("lines").alias("line_end"), F.col("lines").alias("loc"), F.lit(0).alias("complexity"))
    return small.unionByName(whole).unionByName(methods).unionByName(free)


def chunk_priority(found: Column, changed: Column, complexity: Column, nesting: Column) -> Column:
    """0 for a piece with findings of worth or changes, 1 for a complex or deep one, else 2."""
    return F.when(found | changed, 0).when((complexity >= 15) | (nesting >= 5), 1).otherwise(2)


def context(pieces: DataFrame, edges: DataFrame, functions: DataFrame, findings: DataFrame, callees: int = 5, most_bytes: int = 2000) -> DataFrame:
    """``node, callees, findings``: heads of the first ``callees`` functions that each piece (``node, path, line_start, line_end``) calls while they fit ``most_bytes``, and the rules found in it."""
    heads = functions.select(F.col("node").alias("callee"), F.substring_index("body", "\n", 1).alias("head"))
    each = edges.select(F.col("caller").alias("node"), "callee").distinct().join(heads, "callee")
    order = Window.partitionBy("node").orderBy("callee")
    so_far = F.sum(F.octet_length("head")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = each.withColumn("place", F.row_number().over(order)).withColumn("bytes", so_far).where((F.col("place") <= callees) & (F.col("bytes") <= most_bytes))
    shown = fits.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.trim("head").alias("head")))), lambda x: x["head"]), "\n").alias("callees"))
    reach = pieces.select("node", "path", F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    near = reach.join(findings.select("path", "line_no", "rule_id").distinct(), ["path", "line_no"]).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("findings"))
    return pieces.select("node").join(shown, "node", "left").join(near, "node", "left").fillna("", ["callees", "findings"])


def answers(prompts: DataFrame, ask: Callable[[str], str], key: str = "node") -> DataFrame:
    """``key, answer`` of ``key, prompt``: what ``ask`` says to each; a failure is a null answer, a null prompt is not asked."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prompt in batch.column(1).to_pylist():
                try:
                    out.append(ask(prompt) if prompt is not None else None)
                except Exception:  # noqa: BLE001  whatever a model's client raises
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "answer"])

    return prompts.select(key, "prompt").mapInArrow(run, f"`{key}` {kind}, answer string")


def findings_in(answer: DataFrame) -> DataFrame:
    """The columns of ``answer`` but the text, and one row for each finding in its JSON; an answer that cannot be read has none."""
    rest = [c for c in answer.columns if c != "answer"]
    said = F.from_json(json_of(F.col("answer")), FINDINGS)
    return answer.select(*rest, F.explode(said["findings"]).alias("f")).select(*rest, "f.*")


def shows_dereference(evidence: Column) -> Column:
    """Whether a report's evidence is of a null that is used: it names such a failure, or quotes a call whose result is used at once."""
    low = F.lower(F.coalesce(evidence, F.lit("")))
    named = F.arrays_overlap(F.split(low, "[^a-z]+"), F.array(*map(F.lit, FAILURE_WORDS)))
    return named | _any([F.contains(low, F.lit(p)) for p in FAILURE_PHRASES]) | low.rlike(USED_AT_ONCE)


def critic_keeps(rows: DataFrame, votes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of several explorers, of each key the first by ``order``, without those that the critic's ``votes`` (key, ``answer``) call false."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    once = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    refused = votes.where(verdict_of(F.col("answer")) == "ai-verified-fp").select(*key).distinct()
    return once.join(refused, key, "left_anti")


def merge_tiers(rows: DataFrame, known: DataFrame, threshold: int = 6, floor: int = 3) -> DataFrame:
    """``id, tier, match, category, severity, confidence`` of a model's findings ``id, path, line_no, category, severity, confidence, evidence``.

    Unknown categories and confidence below ``floor`` are dropped. A finding of
    ours (``path, line_no``) on the line, or the first within three lines, is
    ``local``: it is raised, nothing is added; else it is ``primary`` from
    ``threshold`` on, and ``supplementary`` below. A model alone is never
    critical, and a null dereference high only with evidence of one.
    """
    said = F.lower("category")
    kept = rows.where(said.isin(list(CATEGORIES)) & (F.col("confidence") >= floor))
    near = nearest_match(kept.select("path", "line_no").distinct(), known, "path", 3)
    both = kept.join(near, ["path", "line_no"], "left")
    severity = lookup({"critical": "high", "high": "high", "medium": "medium", "low": "low"}, F.lower("severity"), "medium")
    proved = shows_dereference(F.col("evidence"))
    severity = F.when((said == "null_safety") & (severity == "high") & ~proved, "medium").otherwise(severity)
    tier = F.when(F.col("match").isNotNull(), "local").when(F.col("confidence") >= threshold, "primary").otherwise("supplementary")
    grade = F.when(F.col("match").isNotNull(), "high").when(F.col("confidence") >= 8, "medium").otherwise("low")
    return both.select("id", tier.alias("tier"), "match", lookup(CATEGORIES, said, None).alias("category"), severity.alias("severity"), grade.alias("confidence"))


def suspicions(rows: DataFrame, ordinal: str, top: int = 500, floor: int = 3) -> DataFrame:
    """The ``top`` findings of a first pass with ``points``: 10 for each grade of severity, confidence within 1..10, 4 for an urgent category.

    The first by ``ordinal`` of those that agree in file, lines and title; equal
    points stay in order.
    """
    key = ["path", "line_start", "line_end", "title"]
    first = rows.where(F.col("confidence") >= floor).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))).where("_n = 1").drop("_n")
    points = 10 * lookup(SEVERITY_POINTS, F.lower(F.coalesce("severity", F.lit("medium"))), 2) + F.least(F.lit(10), F.greatest(F.lit(1), F.col("confidence"))) + F.when(F.col("category").isin(URGENT_CATEGORIES), 4).otherwise(0)
    return first.withColumn("points", points).orderBy(F.desc("points"), ordinal).limit(top)


def final_verdicts(findings: DataFrame, cached: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``id, status, passed``: the verdict on each finding ``id, rule_id, severity`` and the pass that gave it (0: remembered).

    A remembered verdict stands. Else the first pass decides, unless it is
    unsure, the finding critical or high, or its rule one that needs more
    evidence: then the second pass does, if it says anything. ``cached``,
    ``first`` and ``second`` are ``id, status``; a finding that nothing judged is
    ``ai-skipped``.
    """
    of = lambda df, name: df.select("id", F.col("status").alias(name))
    rows = findings.join(of(cached, "kept"), "id", "left").join(of(first, "one"), "id", "left").join(of(second, "two"), "id", "left")
    decisive = F.coalesce(F.col("one").isin("ai-verified-true", "ai-verified-fp"), F.lit(False))
    again = F.col("severity").isin("critical", "high") | F.coalesce(F.col("rule_id").isin(SECOND_PASS_RULES), F.lit(False)) | ~decisive
    status = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("one").isNull(), "ai-skipped").when(again & F.col("two").isNotNull(), F.col("two")).otherwise(F.col("one"))
    passed = F.when(F.col("kept").isNotNull(), 0).when(F.col("one").isNull(), F.lit(None)).when(again & F.col("two").isNotNull(), 2).otherwise(1)
    return rows.select("id", status.alias("status"), passed.cast("int").alias("passed"))


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings ``id, severity, blocks, evidence_level, tags`` as the verdicts ``id, status`` leave them.

    True: confirmed. False: only information, not blocking, to be reviewed; it
    stays in the table. Unsure or skipped: tagged.
    """
    rows = findings.join(verdicts.select("id", "status"), "id", "left")
    true, false = F.col("status") == "ai-verified-true", F.col("status") == "ai-verified-fp"
    sure = lambda c: F.coalesce(c, F.lit(False))
    tag = F.when(true, "ai-confirmed").when(false, "ai-fp").otherwise(F.col("status"))
    out = rows.withColumn("severity", F.when(sure(false), "info").otherwise(F.col("severity"))).withColumn("blocks", F.col("blocks") & ~sure(false))
    out = out.withColumn("evidence_level", F.when(sure(true), "static-confirmed").when(sure(false), "needs-review").otherwise(F.col("evidence_level")))
    return out.withColumn("tags", F.when(tag.isNull(), F.col("tags")).otherwise(F.array_append("tags", tag))).select(*findings.columns, "status")


def without_refused(findings: DataFrame, status: str = "status") -> DataFrame:
    """The findings that no reviewer has called false; one without a status stays."""
    return findings.where(F.coalesce(F.col(status), F.lit("")) != "ai-verified-fp")


def tally(verdicts: DataFrame) -> DataFrame:
    """One row: how many findings were confirmed, refused, unsure and skipped."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0)).cast("long")
    return verdicts.agg(n("ai-verified-true").alias("confirmed"), n("ai-verified-fp").alias("refused"), n("ai-uncertain").alias("unsure"), n("ai-skipped").alias("skipped"))


def evidence(hits: DataFrame, lines: DataFrame, key: list[str], before: int = 5, after: int = 25, most_bytes: int = 2000) -> DataFrame:
    """``key, line_no, text``: the lines around each hit, from above, as far as they fit ``most_bytes``."""
    wanted = hits.select(*key, "line_no", F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("at"))
    near = wanted.join(lines.select(*key, F.col("line_no").alias("at"), "line"), [*key, "at"])
    so_far = F.sum(F.octet_length("line") + 1).over(Window.partitionBy(*key, "line_no").orderBy("at"))
    fits = near.withColumn("bytes", so_far).where(F.col("bytes") <= most_bytes)
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    return fits.groupBy(*key, "line_no").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def chunk_key(language: Column, source: Column) -> Column:
    return F.sha2(F.concat_ws(":", language, source), 256)


def verdict_key(path: Column, line_no: Column, rule: Column, window: Column, model: Column, version: Column) -> Column:
    """Key of a remembered verdict: the place, the rule, a digest of the lines around, and who was asked how."""
    return F.sha2(F.concat_ws("|", path, line_no.cast("string"), rule, F.substring(F.sha2(window, 256), 1, 16), model, version), 256)


def remembered(wanted: DataFrame, cache: DataFrame, key: str, made: str, now: Column, days: int = 7) -> DataFrame:
    """Wanted rows with the newest entry of their key that is at most ``days`` old; without one the entry's columns are null."""
    rest = [c for c in cache.columns if c not in (key, made)]
    fresh = cache.where(F.col(made) >= now - F.expr(f"interval {int(days)} days")).groupBy(key).agg(F.max_by(F.struct(*rest), made).alias("_e"))
    return wanted.join(fresh, key, "left").select(*wanted.columns, *[F.col("_e")[c].alias(c) for c in rest])


def paced(requests: DataFrame, limiter: str, at: str, per_second: float) -> DataFrame:
    """Requests with ``start``, in seconds: a bucket of one token that refills at a rate lets each go no sooner than it comes and ``1 / per_second`` after the one before.

    One limiter's requests are scanned in ranges, so that they need no one task.
    """
    return scan.paced(requests, [limiter], [at], at, per_second)


def best_process(found: DataFrame, flows: DataFrame) -> DataFrame:
    """For each finding (``id, node``) the flow (``origin, node, depth, sensitive``) it belongs to: a sensitive one first, then the shallowest, then by origin."""
    both = found.join(flows, "node")
    first = F.min(F.struct((~F.col("sensitive")).alias("plain"), "depth", "origin"))
    return both.groupBy("id").agg(first.alias("f")).select("id", "f.origin", "f.depth", (~F.col("f.plain")).alias("sensitive"))
