from quarryline.operators import code, line_rules
from quarryline.operators.lines import explode_lines
from quarryline.operators.rule_catalog import RULES, rule_table
from quarryline.plans.code_fixtures import FIXTURES


def hits_of(spark, rows):
    files = spark.createDataFrame(rows, "path string, lang string, content string")
    found = line_rules.line_hits(explode_lines(files, ["path", "lang"], "content")).unionByName(code.syntax_hits(files))
    out = {}
    for r in found.distinct().collect():
        out.setdefault(r.path, set()).add((r.rule_id, r.line_no))
    return out


def test_flagged_and_clean(spark):
    got = hits_of(spark, [(f"{i}{kind}", lang, text) for i, (_, lang, bad, _, good) in enumerate(FIXTURES) for kind, text in (("bad", bad), ("good", good))])
    for i, (rule, lang, bad, line, good) in enumerate(FIXTURES):
        assert [h for h in got.get(f"{i}bad", ()) if h[0] == rule] == [(rule, line)], (rule, lang, bad)
        assert not [h for h in got.get(f"{i}good", ()) if h[0] == rule], (rule, lang, good)


def test_every_rule_of_a_text_has_a_fixture():
    elsewhere = {"cross_function", "business_process", "oo_design", "dependency", "complexity", "git"}
    nowhere = {"MISSING-RESOURCE-LIMIT", "FEATURE-ENVY"}  # registered names that nothing emits
    project = {"LOW-PROJECT-COVERAGE", "LOW-FILE-COVERAGE", "LOW-CHANGE-COVERAGE", "ENV-FILE-TRACKED", "DOCKERFILE-ROOT-USER"}
    wanted = {r.rule_id for r in RULES.values() if r.engine not in elsewhere} - nowhere - project
    assert wanted == {f[0] for f in FIXTURES}


def test_edges(spark):
    lines = [("a", None, 1, "eval(x)"), ("b", "javascript", 1, None), ("c", "javascript", 1, "// eval(x)"), ("d", "unknown", 1, "print(x)"), ("e", "lua", 1, "-- print(x)"), ("f", "cpp", 1, "  *p = rand();")]
    got = {(r.path, r.rule_id) for r in line_rules.line_hits(spark.createDataFrame(lines, "path string, lang string, line_no int, line string")).collect()}
    assert got == {("f", "INSECURE-RANDOM")}
    assert rule_table(spark).count() == len(RULES) and line_rules.line_rule_table(spark).where("severity is null").count() == 0


def test_deep_and_broken_texts(spark):
    deep = "x = " + " + ".join(["a"] * 2_500) + "\nprint(x)\n"
    nested = "x = " + "(" * 5_000 + ")" * 5_000
    blocks = "if a:\n" + "".join("    " * i + "if a:\n" for i in range(1, 90)) + "    " * 90 + "print(1)\n"
    braces = "class A { void f() " + "{ if (x) " * 3_000 + "}" * 3_000 + "}"
    rows = [("deep.py", "python", deep), ("nested.py", "python", nested), ("blocks.py", "python", "def f(a):\n" + "\n".join("    " + x for x in blocks.split("\n"))), ("A.java", "java", braces), ("none.py", "python", None), ("empty.go", "go", ""), ("open.java", "java", "class A { void f() {"), ("\0.py", "python", "a\0b")]
    got = hits_of(spark, rows)
    assert ("PRINT-DEBUG", 2) in got["deep.py"] and ("SYNTAX-ERROR", 1) in got["nested.py"]
    files = spark.createDataFrame(rows, "path string, lang string, content string")
    assert {r.path for r in code.blocks(files).where("kind = 'function'").collect()} >= {"A.java", "open.java"}
