import pytest
from pyspark.sql import functions as F

from quarryline.operators import findings


def column(spark, kind, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_columns(spark):
    assert column(spark, "string", ["tests/a.py", "src/tests/a.py", "test_a.py", "a/b_test.py", "x/a.spec.ts", "src/contest.py", None, "tests", "win\\tests\\a.py"], findings.is_test_path) == [True, True, True, True, True, False, False, True, True]
    assert column(spark, "string", ["a/b/c.py", "c.py", "a\\b"], findings.module_of) == ["a", ".", "a"]
    assert column(spark, "string", ["SELF-ASSIGNMENT", "OTHER", None], lambda c: findings.evidence_level(c, F.lit("high"))) == ["static-confirmed", "likely", "likely"]
    assert column(spark, "string", ["git", "odd", None], lambda c: findings.dimension(c, F.lit("testing"))) == ["evolution", "testing", "testing"]
    assert column(spark, "string", ["nothing", None], lambda c: findings.dimension(c, c)) == ["other", "other"]
    assert column(spark, "string", ["security", None], lambda c: findings.is_blocking(F.lit(None).cast("boolean"), c, F.lit("high"), F.lit("high"))) == [True, False]
    assert column(spark, "string", ["likely", "odd"], findings.evidence_rank) == [3, 0]


@pytest.mark.parametrize(
    ("answer", "status"),
    [("```json\n{\"verdict\": \"TP\"}\n```", "ai-verified-true"), ("so {\"verdict\": \" fp \", \"reason\": \"x\"} it is", "ai-verified-fp"), ('{"verdict": "unsure"}', "ai-uncertain"), ('{"verdict": "maybe"}', None), ("none", None), ("{broken", None), (None, None)],
)
def test_verdicts(spark, answer, status):
    assert column(spark, "string", [answer], findings.verdict_of) == [status]


def test_changed_files(spark):
    rows = spark.createDataFrame([(1, "a.py"), (2, "b.py"), (3, "project"), (4, ""), (5, None)], "id int, path string")
    changed = spark.createDataFrame([("a.py",), ("a.py",), (None,)], "path string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(findings.in_changed_files(rows, changed)) == [1, 3, 4, 5]
    assert ids(findings.in_changed_files(rows, None)) == [1, 2, 3, 4, 5]


def test_resolve_calls(spark):
    symbols = spark.createDataFrame([("a.py", "A", "f", "a.A.f"), ("b.py", "B", "f", "b.B.f"), ("b.py", None, "g", "b.g"), *[(f"{c}.py", None, "many", f"{c}.many") for c in "wxyz"]], "path string, class string, name string, qualified string")
    sites = spark.createDataFrame([("a.py", "A", "f"), ("c.py", "B", "f"), ("c.py", None, "g"), ("c.py", None, "many"), ("c.py", None, "none")], "path string, class string, callee string")
    got = {(r.path, r.callee, r.target, r.confidence) for r in findings.resolve_calls(sites, symbols).collect()}
    assert got == {("a.py", "f", "a.A.f", 0.95), ("c.py", "f", "b.B.f", 0.9), ("c.py", "g", "b.g", 0.6), *[("c.py", "many", f"{c}.many", 0.5) for c in "wxy"]}


def test_chains(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None), ("e", "lost")], "node string, parent string")
    got = {r.node: r.chain for r in findings.chains(parents, "node", "parent").collect()}
    assert got == {"a": ["a", "b", "c"], "b": ["b", "c", "a"], "c": ["c", "a", "b"], "d": ["d"], "e": ["e", "lost"]}


def test_file_states(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, h string")
    assert {tuple(r) for r in findings.file_states(old, new, "path", "h").collect()} == {("b", "changed"), ("c", "deleted"), ("d", "new")}
