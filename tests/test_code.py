import pytest

from quarryline.operators import code, graph, python_rules
from quarryline.operators.lines import explode_lines

PY = '''import os
class Base(object):
    def run(self, a, *b, c=1, **d):
        if a and b or c:
            for x in b:
                helper(x)
        return self.stop()

    async def stop(self):
        def deep():
            return Base()
        return deep()


def helper(x):
    return x
'''
JAVA = '''package a;
// class Not { }
public class Shop extends Base implements One, Two {
    private String s = "{ not a block }";
    public int sell(int n, Map<String, Integer> m) {
        if (n > 0 && m != null) {
            while (true) { n--; }
        }
        return new Item(n).price();
    }
    /* void old() {
    } */
    void idle() { }
}
'''


def frame(spark, *files):
    return spark.createDataFrame(list(files), "path string, lang string, content string")


def test_blocks(spark):
    got = code.blocks(frame(spark, ("a.py", "python", PY), ("b.java", "java", JAVA), ("c.py", "python", "def ("), ("d", None, "x {"), ("e.py", "python", None), ("f.go", "go", "func (s *S) Get(a int) error {\n\treturn nil\n}\nfunc open() {")))
    rows = {(r.path, r.name): r for r in got.collect()}
    assert len(rows) == 10
    run, stop, sell = rows["a.py", "run"], rows["a.py", "stop"], rows["b.java", "sell"]
    assert (run.owner, run.start_line, run.end_line, run.params, run.complexity, run.nesting) == ("Base", 3, 7, 5, 5, 2)
    assert stop.is_async and rows["a.py", "deep"].owner == "Base.stop" and rows["a.py", "Base"].bases == ["object"]
    assert (sell.owner, sell.start_line, sell.end_line, sell.params, sell.complexity, sell.nesting) == ("Shop", 5, 10, 2, 4, 2)
    assert rows["b.java", "Shop"].bases == ["Base", "One", "Two"] and rows["b.java", "idle"].start_line == 13
    assert (rows["f.go", "Get"].params, rows["f.go", "Get"].end_line, rows["f.go", "open"].end_line) == (1, 3, 4)


def test_call_sites_and_walk(spark):
    files = frame(spark, ("a.py", "python", PY), ("b.java", "java", JAVA))
    sites = code.call_sites(explode_lines(files, ["path"], "content"), code.blocks(files))
    got = {(r.caller, r.line_no, r.form, r.receiver, r.callee) for r in sites.collect()}
    assert {("Base.run", 6, "free", None, "helper"), ("Base.run", 7, "method", "self", "stop"), ("Base.stop.deep", 11, "constructor", None, "Base"), ("Base.stop", 12, "free", None, "deep"), ("Shop.sell", 9, "constructor", None, "Item")} <= got
    edges = sites.selectExpr("caller", "callee", "0.9 as confidence")
    assert {r.node for r in graph.entry_points(edges).collect()} >= {"Base.run", "Shop.sell"}


def test_module_edges(spark):
    files = frame(spark, ("a.py", "python", "import b\nimport b\nfrom os import path\nimport a\n"), ("b.py", "python", "from a import x\n"))
    known = spark.createDataFrame([("a", "a.py"), ("b", "b.py")], "module string, path string")
    assert {tuple(r) for r in code.module_edges(explode_lines(files, ["path"], "content"), known).collect()} == {("a", "b"), ("b", "a")}


# One text that a rule flags and one, alike, that it does not.
TWINS = {
    "EMPTY-EXCEPT": ("try:\n    f()\nexcept KeyError:\n    pass\n", "try:\n    f()\nexcept KeyError:\n    g()\n"),
    "BARE-EXCEPT": ("try:\n    f()\nexcept:\n    g()\n", "try:\n    f()\nexcept KeyError:\n    g()\n"),
    "BROAD-EXCEPT": ("try:\n    f()\nexcept Exception:\n    g()\n", "try:\n    f()\nexcept ValueError:\n    g()\n"),
    "LOG-ONLY-EXCEPT": ("try:\n    f()\nexcept KeyError:\n    logger.info('x')\n", "try:\n    f()\nexcept KeyError:\n    logger.info('x')\n    raise\n"),
    "PRINT-DEBUG": ("print(1)\n", "printer(1)\n"),
    "ASSERT-USED": ("assert x\n", "check(x)\n"),
    "ALWAYS-TRUE-FALSE": ("if True:\n    f()\n", "if x:\n    f()\n"),
    "EXCEPTION-NOT-RAISED": ("ValueError('x')\n", "raise ValueError('x')\n"),
    "MUTABLE-DEFAULT-ARG": ("def f(a, b=[]):\n    g()\n", "def f(a, b=()):\n    g()\n"),
    "SUBPROCESS-SHELL-TRUE": ("subprocess.run(c, shell=True)\n", "subprocess.run(c, shell=False)\n"),
    "SELF-ASSIGNMENT": ("a.b = a.b\n", "a.b = a.c\n"),
    "EXCEPTION-LOST-CONTEXT": ("try:\n    f()\nexcept KeyError as e:\n    raise X('a')\n", "try:\n    f()\nexcept KeyError as e:\n    raise X('a') from e\n"),
    "INFINITE-RECURSION-RISK": ("def f(n):\n    return f(n - 1)\n", "def f(n):\n    return n and f(n - 1)\n"),
    "INFINITE-LOOP-RISK": ("while True:\n    for x in y:\n        break\n", "while True:\n    if f():\n        break\n"),
    "DICT-ITERATE-MUTATE": ("for k in d.keys():\n    del d[k]\n", "for k in list(d):\n    del d[k]\n"),
    "DUPLICATE-DICT-KEY": ("d = {'a': 1, 'a': 2}\n", "d = {'a': 1, 'b': 2}\n"),
    "DIVISION-BY-ZERO-RISK": ("x = a / 0\n", "x = a / 2\n"),
    "UNREACHABLE-CODE": ("def f():\n    return 1\n    g()\n", "def f():\n    g()\n    return 1\n"),
    "SETTER-RETURNS-VALUE": ("def set_a(self, v):\n    return v\n", "def set_a(self, v):\n    return None\n"),
    "EVAL-USAGE": ("eval(x)\n", "ast.literal_eval(x)\n"),
    "WEAK-HASH": ("hashlib.md5(x)\n", "hashlib.sha256(x)\n"),
    "UNSAFE-DESERIALIZATION": ("yaml.load(x)\n", "yaml.load(x, Loader=SafeLoader)\n"),
    "HTTP-NO-TIMEOUT": ("requests.get(u)\n", "requests.get(u, timeout=3)\n"),
    "BUSY-WAIT": ("while x:\n    pass\n", "while x:\n    f()\n"),
    "BLOCKING-CALL-IN-ASYNC": ("async def f():\n    time.sleep(1)\n", "async def f():\n    await s(1)\n"),
    "SYNTAX-ERROR": ("def (\n", "def f(): g()\n"),
}


@pytest.mark.parametrize("rule", TWINS)
def test_rule_twins(rule):
    bad, good = TWINS[rule]
    assert rule in {h[0] for h in python_rules.hits(bad)}
    assert rule not in {h[0] for h in python_rules.hits(good)}


def test_hits_as_rows(spark):
    files = frame(spark, ("a.py", "python", "print(1)\n\nassert x\n"), ("b.py", "python", None), ("c.java", "java", "print(1)"))
    assert {tuple(r) for r in code.syntax_hits(files).collect()} == {("a.py", "PRINT-DEBUG", 1, 1), ("a.py", "ASSERT-USED", 3, 3)}
