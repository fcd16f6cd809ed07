"""Generated headers, suppression marks, evidence, owners and duplication on small texts."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import metrics, review, triage
from quarryline.sources import files

WRITTEN_BY_PROGRAMS = [
    "// Code generated by protoc-gen-go. DO NOT EDIT.\n// source: shop.proto\npackage shop\n",
    "# -*- coding: utf-8 -*-\n# Generated by the protocol buffer compiler.  DO NOT EDIT!\n",
    "/**\n * Autogenerated by Thrift Compiler (0.13.0)\n *\n */\n",
    "//------\n// <auto-generated>\n//     This code was generated by a tool.\n",
    "package a;\n\n@javax.annotation.Generated(value = \"x\")\npublic class A {}\n",
    "/*\n * NOTE: This class is auto generated by the swagger code generator program.\n */\n",
    "// Generated from Expr.g4 by ANTLR 4.9\n",
    "# This file is automatically generated; changes are lost.\n",
    "/* This file is @generated by hand-off. */\n",
    "; please do not modify\n; source: api/shop.thrift\n",
    "using X;\n[System.CodeDom.Compiler.GeneratedCode(\"t\", \"1\")]\nclass A {}\n",
]
WRITTEN_BY_HAND = [
    "# Values generated by the solver are kept for a day.\nx = 1\n",
    "text = 'Code generated by hand'\n",
    "// do not edit while the tests run\nint x;\n",
    "# The source is shop.proto, see there.\n",
    "def generated(x):\n    return x\n",
    "x\n" * 3000 + "// Code generated by a tool\n",
    "",
    None,
]


def test_generated_headers(spark):
    rows = spark.createDataFrame([(t,) for t in WRITTEN_BY_PROGRAMS + WRITTEN_BY_HAND], "t string")
    got = [bool(r.g) for r in rows.select(files.is_generated(F.col("t")).alias("g")).collect()]
    assert got == [True] * len(WRITTEN_BY_PROGRAMS) + [False] * len(WRITTEN_BY_HAND)


def test_generated_names(spark):
    names = {"a/shop.pb.go": True, "shop_types.py": True, "shop_types.txt": False, "openapi_client.ts": True, "my-openapi.ts": False, "x.generated.tsx": True, "generated.ts": False, "a_service.rb": True, "service.rb": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.g for r in rows.select("n", files.generated_name(F.col("n")).alias("g")).collect()} == names


def test_marks(spark):
    lines = {
        "x = 1  # noqa": ["*"],
        "x = 1  # NOQA: A-1, b_2 because of c.": ["A-1", "B_2", "BECAUSE", "OF", "C"],
        "// see http://x // audit: ignore C-3": ["C-3"],
        "# audit:ignore": ["*"],
        "# audit: ignored A": None,
        "noqa": None,
        "# about noqa": None,
        "": None,
    }
    rows = spark.createDataFrame([(n,) for n in lines], "line string")
    assert {r.line: r.ids for r in rows.select("line", triage.taken_back(F.col("line")).alias("ids")).collect()} == lines


def test_evidence_of_a_dereference(spark):
    texts = {"raises NullPointerException": True, "an NPE follows": True, "x.get(1).y": True, "find(k)->name": True, "nil pointer": True, "'NoneType' has no": True, "x may be null": False, "foo(bar)": False, "onpe": False, None: False}
    rows = spark.createDataFrame([(n,) for n in texts], "e string")
    assert {r.e: r.d for r in rows.select("e", review.shows_dereference(F.col("e")).alias("d")).collect()} == texts


def test_the_first_explorer_counts(spark):
    rows = spark.createDataFrame([("a", 1, 3, "late"), ("a", 1, 1, "first"), ("b", 2, 1, "other")], "path string, line_no int, explorer int, said string")
    votes = spark.createDataFrame([("b", 2, '{"verdict": "false"}')], "path string, line_no int, answer string")
    assert [r.said for r in review.critic_keeps(rows, votes, ["path", "line_no"], ["explorer"]).collect()] == ["first"]


def test_owners_are_text(spark):
    rows = [("f", "ann@x", "c1", 3), ("f", "ann@x", "c1", 4), ("f", "bob@x", "c2", 1), ("g", "bob@x", "c2", 1), ("f", None, "c3", 0)]
    df = spark.createDataFrame(rows, "path string, author string, hash string, n int")
    got = {r["path"]: tuple(r)[1:] for r in metrics.ownership(df, "path", "author", "n", "hash").collect()}
    assert got["g"] == (1, 1, 1, "bob@x", 1.0)
    assert got["f"][:3] == (8, 3, 3) and got["f"][4] == pytest.approx(0.333)
    assert metrics.ownership(df.where("author is not null"), "path", "author", "n").where("path = 'f'").first()["top_author"] == "ann@x"


def test_duplication_within_texts_equals_that_of_lines(spark):
    import random

    from quarryline.operators.lines import explode_lines

    rng = random.Random(4)
    pool = ["a  b", "# c", "", "x\ty ", "// z", "same", "end"]
    docs = [(i, rng.choice("pqr"), "\n".join(rng.choice(pool + [str(rng.randrange(3))]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100, "p", "l1\nl2\nl3\nl4\nl5\nl6\r\nl7"), (101, "p", "l1\nl2\nl3\r\nl4\nl5\nl6\nl7"), (102, "solo", "one"), (103, "p", None), (104, "q", "w\n" * 5000)]
    df = spark.createDataFrame(docs, "doc_id int, source string, text string")
    want = sorted(tuple(r) for r in metrics.duplication_rate(explode_lines(df, ["doc_id", "source"]), ["source"], "doc_id", "line_no").collect())
    got = sorted(tuple(r) for r in metrics.text_duplication(df, ["source"], "doc_id").collect())
    assert got == want and any(r[2] for r in got)


def test_causes(spark):
    from quarryline.operators import findings

    rows = spark.createDataFrame([("WEAK-HASH", "weak", "md5", "old", None, "http://x"), ("NONE", None, "", None, ["CWE-7"], ""), ("RESOURCE-LEAK", "leak", None, "", None, None)], "rule string, title string, detail string, said string, cwe array<string>, link string")
    c = F.col
    got = [r.t for r in rows.select(findings.cause(c("rule"), c("title"), c("detail"), c("said"), c("cwe"), None, c("link")).alias("t")).collect()]
    assert got == [
        "old\n[WEAK-HASH] weak — md5\nSee: CWE-327 (https://cwe.mitre.org/data/definitions/327.html); OWASP A02:2021 (https://owasp.org/Top10/)\nMore: http://x",
        "[NONE] \nSee: CWE-7 (https://cwe.mitre.org/data/definitions/7.html)",
        "[RESOURCE-LEAK] leak\nSee: CWE-772 (https://cwe.mitre.org/data/definitions/772.html); CWE-404 (https://cwe.mitre.org/data/definitions/404.html)",
    ]


def test_imports_of_three_languages(spark):
    from quarryline.operators import code

    lines = [("a.py", "python", "from x.y import z"), ("a.py", "python", "import os.path as p"), ("a.py", "python", "# import no"), ("A.java", "java", "import static org.x.B.c;"), ("A.java", "java", "import org.y.*;"), ("a.go", "go", 'import "fmt"'), ("a.go", "go", '\tlog "example.org/x/log"'), ("a.go", "go", 'x := "no"'), ("a.rb", "ruby", "import x")]
    got = {(r.path, r.module) for r in code.imported(spark.createDataFrame(lines, "path string, lang string, line string")).collect()}
    assert got == {("a.py", "x.y"), ("a.py", "os.path"), ("A.java", "org.x.B.c"), ("A.java", "org.y"), ("a.go", "fmt"), ("a.go", "example.org/x/log")}


def test_hints_of_the_library(spark):
    from quarryline.operators import findings

    files = spark.createDataFrame([("x/package.json", '{"react": 1}'), ("a.py", "import pytest\nfrom flask import x")], "path string, content string")
    assert {(r.kind, r.name, r.score) for r in findings.detected(files).collect()} == {("build", "npm", 5), ("framework", "nodejs", 1), ("framework", "react", 3), ("test", "pytest", 4), ("framework", "flask", 2)}
