import json

from quarryline.sinks import reports
from quarryline.sources import coverage, files, history


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_change_log(spark, tmp_path):
    log = "@@Caaa|x@e|100\n\n3\t1\ta.py\n-\t-\tpic.png\n@@Cbbb||90000\n1\t0\ta.py\n1\t0\ta.py\n@@Cbroken\n9\t9\tb.py\n@@Cccc|x@e|oops\n2\t2\tdir\\b.py\n"
    (tmp_path / "log.txt").write_text(log)
    got = history.change_log(spark, str(tmp_path / "log.txt"), "@@C")
    assert rows(got, "commit", "author", "path", "added", "deleted") == [("aaa", "x@e", "a.py", 3, 1), ("aaa", "x@e", "pic.png", 0, 0), ("bbb", "unknown", "a.py", 1, 0), ("bbb", "unknown", "a.py", 1, 0), ("ccc", "x@e", "dir/b.py", 2, 2)]
    assert rows(history.file_history(got).where("path = 'a.py'"), "changed", "commits", "authors", "top_author", "top_share") == [(6, 2, 2, "unknown", 0.5)]


def test_changed_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n@@ -9,2 +10,0 @@\n-z\n-z\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -0,0 +7 @@ def f\n+q\n")
    assert rows(history.changed_lines(spark, str(tmp_path / "d.txt")), "path", "line_no") == [("x", 1), ("x", 2), ("y", 7)]


def json_report(**files):
    """Counts default to none at all, as some tools write them."""
    return json.dumps({"meta": {"format": 3}, "files": files})


def test_json_coverage(spark, tmp_path):
    counted = {"executed_lines": [4, 9, 10, 11, 30, 31, 32], "missing_lines": [12], "summary": {"covered_lines": 7, "num_statements": 8, "covered_branches": 3, "num_branches": 4, "covered_functions": 1, "num_functions": 3}}
    uncounted = {"executed_lines": [1, 1, 2], "missing_lines": [3, 3, 8]}  # repeated lines count once
    half = {"executed_lines": [], "missing_lines": [5, 6], "summary": {"num_statements": 6}}  # covered: all but the missing
    (tmp_path / "a.json").write_text(json_report(**{"pkg\\ledger.py": counted, "pkg/tally.py": uncounted, "pkg/half.py": half, "pkg/void.py": {}, "pkg/null.py": None}))
    (tmp_path / "b.json").write_text("[1, 2")
    (tmp_path / "c.json").write_text("")
    got = coverage.json_reports(spark, str(tmp_path / "*.json"))
    assert rows(got, "path", "covered_lines", "total_lines") == [("pkg/half.py", 4, 6), ("pkg/ledger.py", 7, 8), ("pkg/tally.py", 2, 4)]
    assert rows(coverage.totals(got), "lines", "branches", "functions") == [(72.2, 75.0, 33.3)]
    changed = spark.createDataFrame([("pkg/ledger.py", 12), ("pkg/ledger.py", 30), ("pkg/ledger.py", 30), ("pkg/ledger.py", 77), ("pkg/tally.py", 8), ("other.py", 1)], "path string, line_no int")
    assert rows(coverage.changed_coverage(got, changed), "covered", "total", "percent") == [(1, 3, 33.3)]
    assert rows(coverage.changed_coverage(got, changed.where("path = 'other.py'")), "covered", "total", "percent") == [(0, 0, 0.0)]
    (tmp_path / "d.json").write_text(json_report(**{"pkg/half.py": {"executed_lines": [5, 6], "missing_lines": [], "summary": {"covered_lines": 6, "num_statements": 6}}}))
    later = coverage.latest(coverage.json_reports(spark, str(tmp_path / "*.json")))
    assert rows(later.where("path = 'pkg/half.py'"), "covered_lines", "total_lines") == [(6, 6)] and later.count() == 3


def test_xml_coverage(spark, tmp_path):
    line = lambda n, hits, rest="": f'<line number="{n}" hits="{hits}"{rest}/>'
    first = "".join([line(2, 0), line(3, 0), line(5, 7, ' branch="true" condition-coverage="66% (2/3)"'), line(6, 7, ' branch="true" condition-coverage="odd"'), line(9, 0)])
    methods = "".join(f'<method name="m{i}" line-rate="{r}"/>' for i, r in enumerate(["0.5", "0", "1", "0.0", "0.25"]))
    classes = f'<class filename="lib\\queue.py"><methods>{methods}</methods><lines>{first}</lines></class><class filename="lib/none.py"><methods/><lines/></class><class filename=""><lines>{line(1, 1)}</lines></class>'
    (tmp_path / "r.xml").write_text(f"<coverage><packages><package><classes>{classes}</classes></package></packages></coverage>")
    got = coverage.xml_reports(spark, str(tmp_path / "r.xml"))
    assert rows(got, "path", "executed", "missing") == [("lib/queue.py", [5, 6], [2, 3, 9])]
    assert rows(coverage.totals(got), "lines", "branches", "functions") == [(40.0, 66.7, 60.0)]
    assert rows(coverage.totals(got.limit(0)), "lines", "branches", "functions") == [(0.0, None, None)]


def test_scan(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "node_modules/b.js": b"x", "src/c.GO": b"package c", "src/d.py": b"# Generated by a tool. Do not edit.\n", "e.java": b"a\0b", "skip/me.py": b"y", "logs/f.py": b"z", "none": b"\xc3\xa4\xff"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.scan(spark, str(tmp_path), exclude=["skip/*"], ignore_rules=["# no", "logs/", "!a.py"])
    assert rows(got, "path", "lang", "content") == [("a.py", "python", "x = 1\n"), ("none", None, "ä"), ("src/c.GO", "go", "package c")]
    assert rows(files.scan(spark, str(tmp_path), only=["go"]), "path") == [("src/c.GO",)]


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([(0, "R1", "first", "high", "high", "security", "a\\b.py", None, None, True), (1, "R1", "second", "info", "low", "defect", "c.py", 3, 4, False), (7000, "R\"2", "a \"quote\"\n", "odd", "odd", "defect", "c.py", 3, None, False)], "ordinal int, rule_id string, title string, severity string, confidence string, category string, path string, line_start int, line_end int, blocks boolean")
    reports.write_sarif(found, str(tmp_path / "sarif"), "quarryline")
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "sarif")).collect()]
    results = [r for d in docs for r in d["runs"][0]["results"]]
    assert sorted(r["message"]["text"] for r in results) == ["a \"quote\"\n", "first", "second"]
    assert {r["id"]: r["shortDescription"]["text"] for r in docs[0]["runs"][0]["tool"]["driver"]["rules"]} == {"R1": "first", 'R"2': "a \"quote\"\n"}
    one = next(r for r in results if r["message"]["text"] == "first")
    assert one["level"] == "error" and one["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 1}
    for scan in ("1", "2", "2"):
        reports.write_snapshot(found, str(tmp_path / "snap"), scan)
    assert reports.read_snapshots(spark, str(tmp_path / "snap")).groupBy("scan_id").count().count() == 2
