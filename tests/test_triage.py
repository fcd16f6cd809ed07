import json

from pyspark.sql import functions as F

from quarryline.operators import findings, joins, metrics, review, risk, triage
from quarryline.operators.lines import explode_lines
from quarryline.operators.rules import plausible_secret
from quarryline.sinks import reports
from quarryline.streaming import watch


def test_line_ends(spark):
    texts = ["a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i\n", "\n", "", None, "a", "a\n\n", "\r\n", "é "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {}
    for r in explode_lines(df, ["i"]).collect():
        got.setdefault(r.i, []).append((r.line_no, r.line))
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got.get(i, []))] == (t or "").splitlines()


def test_secrets(spark):
    values = {"": False, "'changeme'": False, "${X}": False, "%X%": False, "admin": False, "123456": False, "abcdefg": False, "Abcdefg": False, "abcdefgh": True, "x9!kfoo8": True, "1234567": False, "12345678": True, "a1": True, " root ": False, None: None}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.p for r in df.select("v", plausible_secret(F.col("v")).alias("p")).collect()} == values


def test_suppression_marks(spark):
    text = ["x = f()  # noqa", "y = g()  # noqa: A-1, b-2", "z", "// audit: ignore C-3", "w", "# noqa:", "v", "noqa"]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text, 1)], "path string, line_no int, line string")
    hits = spark.createDataFrame([("p", rule, i) for i in range(1, 9) for rule in ("A-1", "B-2", "c-3")], "path string, rule_id string, line_no int")
    kept = {(r.rule_id, r.line_no) for r in triage.not_suppressed(hits, lines).collect()}
    # line 1 takes back all on 1 and 2; line 2 two rules on 2 and 3; line 4 one on 4 and 5; line 6 all on 6 and 7
    assert kept == {("c-3", 3), ("A-1", 4), ("B-2", 4), ("A-1", 5), ("B-2", 5), ("A-1", 8), ("B-2", 8), ("c-3", 8)}
    assert triage.not_suppressed(hits, lines.limit(0)).count() == hits.count()


def test_numbers_are_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = sorted((r.k, r.number) for r in triage.numbered(df, [F.col("k")]).collect())
    assert got == [(i, i + 1) for i in range(5000)]
    assert triage.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_pacing_matches_a_bucket(spark):
    import random

    rng = random.Random(1)
    arrivals = sorted(round(rng.random() * 20, 3) for _ in range(60))
    rows = spark.createDataFrame([("l", a) for a in arrivals] + [("m", 1.0)], "limiter string, at double")
    got = sorted(r.start for r in review.paced(rows, "limiter", "at", 2.0).where("limiter = 'l'").collect())
    free, want = 0.0, []
    for a in arrivals:
        free = max(a, free)
        want.append(round(free, 6))
        free += 0.5
    assert all(abs(x - y) < 1e-6 for x, y in zip(got, want, strict=True))


def test_spread_join_is_the_same_join(spark, monkeypatch):
    lines = spark.createDataFrame([("g", f"d{d}", i, f"line {i % 9} {d % 3}") for d in range(6) for i in range(40)], "source string, doc string, line_no int, line string")
    want = metrics.duplication_rate(lines, ["source"], "doc", "line_no").collect()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    assert metrics.duplication_rate(lines, ["source"], "doc", "line_no").collect() == want


def test_clusters_without_a_name(spark):
    rows = spark.createDataFrame([("WEAK-HASH", "security"), ("NONE", "testing"), (None, None), ("NONE", "defect")], "rule_id string, category string")
    assert [r.c for r in rows.select(risk.cluster_of(F.col("rule_id"), F.col("category")).alias("c")).collect()] == ["security:crypto", None, None, "defect:exception"]


def test_gate_truths(spark):
    facts = spark.createDataFrame([(True, 3.0, 0.0)], "test_unavailable boolean, findings_total double, a_b double")
    cases = {"test.unavailable == true": True, "test.unavailable != TRUE": False, "test.unavailable > true": False, "findings.total == 3.0005": True, "findings.total >= 300%": False, "a.b == 0 and odd thing": True, "x.y > 5": True, "a.b > 1 or findings.total < 4": True}
    assert {c: facts.select(risk.gate_condition(c, set(facts.columns)).alias("x")).first().x for c in cases} == cases


def test_cache_versions_and_html(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert reports.read_cache(spark, path) is None
    for made, rows in ((1, [("a", 1), ("b", 1)]), (2, [("a", 2)]), (0, [("b", 0), ("c", 0)])):
        reports.update_cache(spark, path, spark.createDataFrame([(k, made, v) for k, v in rows], "key string, made int, v int"), "key", "made")
    assert {(r.key, r.v) for r in reports.read_cache(spark, path).collect()} == {("a", 2), ("b", 1), ("c", 0)}
    found = spark.createDataFrame([("A<1>", "t & u", "high", "security", "a.py", 3), ("B", None, "low", "defect", "b.py", None)], "rule_id string, title string, severity string, category string, path string, line_start int")
    reports.write_html(found, str(tmp_path / "html"), "Report")
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "html")).collect())
    assert "A&lt;1&gt;" in page and "t &amp; u" in page and page.index("high") < page.index("b.py")
    assert reports.terminal_lines(found)[0] == "high: 1  low: 1"
    reports.write_latest(found, str(tmp_path / "json"), "7")
    assert spark.read.json(str(tmp_path / "json" / "latest")).count() == 2
    queue = spark.createDataFrame([("x", 3), ("y", 9)], "title string, points int")
    reports.write_queue(queue, str(tmp_path / "queue"))
    assert [json.loads(r.value)["title"] for r in spark.read.text(str(tmp_path / "queue")).collect()] == ["y", "x"]
    reports.write_graph(spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.9)], "caller string, callee string, confidence double"), str(tmp_path / "graph"))
    assert json.loads(spark.read.text(str(tmp_path / "graph")).first().value) == {"caller": "a", "calls": [{"callee": "b", "confidence": 0.5}, {"callee": "c", "confidence": 0.9}]}


def test_polling_sees_changed_files(spark, tmp_path):
    import os

    (tmp_path / "a.py").write_text("x")
    (tmp_path / "b.py").write_text("x")
    seen, steps = [], iter([lambda: (tmp_path / "a.py").write_text("xyz"), lambda: None, lambda: ((tmp_path / "c.py").write_text("x"), (tmp_path / "b.py").unlink())])
    watch.poll(spark, str(tmp_path), lambda df: seen.append(sorted((os.path.basename(r.path), r.state) for r in df.collect())), 3, lambda: next(steps)(), "*.py")
    assert seen == [[("a.py", "changed")], [("c.py", "added")]]


def test_imports_win_over_names(spark):
    symbols = spark.createDataFrame([("b.py", None, "f", "b.f"), ("c.py", None, "f", "c.f")], "path string, class string, name string, qualified string")
    sites = spark.createDataFrame([("a.py", None, "f")], "path string, class string, callee string")
    brought = spark.createDataFrame([("a.py", "f", "c.py")], "path string, name string, target_path string")
    assert [(r.target, r.confidence) for r in findings.resolve_calls(sites, symbols, brought).collect()] == [("c.f", 0.9)]
    assert sorted((r.target, r.confidence) for r in findings.resolve_calls(sites, symbols).collect()) == [("b.f", 0.5), ("c.f", 0.5)]
