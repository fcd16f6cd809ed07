"""Walks over calls against plain versions: paths, components, cycles, facts that move, receivers, intervals."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.operators import cycles, fixpoint, intervals, joins, paths, summaries, types


def random_edges(rng, nodes, n):
    out = {}
    while len(out) < n:
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        if a != b:
            out[a, b] = rng.choice([0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
    return out


def frame(spark, edges):
    return spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "caller long, callee long, confidence double")


def nodes(spark, some):
    return spark.createDataFrame([(n,) for n in some], "node long")


def every_path(edges, source, sink, depth):
    after = defaultdict(list)
    for (a, b), c in edges.items():
        if c >= 0.5:
            after[a].append((b, c))
    out, todo = [], [([source], 1.0)]
    while todo:
        path, least = todo.pop()
        if path[-1] == sink and len(path) > 1:
            out.append((-least, len(path) - 1, path))
        elif len(path) <= depth:
            todo += [([*path, b], min(least, c)) for b, c in after[path[-1]] if b not in path]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 2, 200])
def test_best_paths_equal_enumeration(spark, width):
    rng = random.Random(width)
    edges = random_edges(rng, 12, 40)
    sources, sinks = [0, 1, 5], [2, 5, 7]
    got = defaultdict(list)
    for r in paths.best_paths(frame(spark, edges), nodes(spark, sources), nodes(spark, sinks), k=4, depth=5, width=width).orderBy("source", "sink", "place").collect():
        got[r["source"], r["sink"]].append(((-r["confidence"], r["hops"], r["path"]), r["sure"]))
    checked = 0
    for s in sources:
        for t in sinks:
            want = every_path(edges, s, t, 5)[:4] if s != t else []
            have = got[s, t]
            assert bool(have) == bool(want)
            if want:
                assert have[0][0][:2] == want[0][:2]  # none is better, however few labels are kept
            for (path, sure), best in zip(have, want, strict=False):
                if not sure:
                    break
                assert path == best
                checked += 1
            if width == 200:
                assert [p for p, _ in have] == want and all(sure for _, sure in have)
    assert checked > 5


def test_best_paths_past_a_hot_node(spark):
    """Three hundred ways meet in one node; labels stay few there."""
    edges = {(0, i): 0.5 + i % 5 / 10 for i in range(1, 300)} | {(i, 1000): 0.9 for i in range(1, 300)} | {(1000, 1001): 0.8}
    got = paths.best_paths(frame(spark, edges), nodes(spark, [0]), nodes(spark, [1001]), k=3, depth=4).orderBy("place").collect()
    assert [(r["path"], r["confidence"], r["sure"]) for r in got] == [([0, i, 1000, 1001], 0.8, False) for i in (4, 9, 14)]  # 0.9 up to the last call; equals of 0.8 were dropped


def plain_components(edges):
    reach = {a: {b for (x, b) in edges if x == a} for a, _ in edges}
    grown = True
    while grown:
        grown = False
        for seen in reach.values():
            more = set().union(*[reach.get(b, set()) for b in seen]) - seen if seen else set()
            if more:
                seen |= more
                grown = True
    return {a: min(b for b in seen if a in reach.get(b, ())) for a, seen in reach.items() if a in seen}


@pytest.mark.parametrize("n", [14, 22, 40])
def test_components_and_cycles(spark, n):
    edges = random_edges(random.Random(n), 18, n)
    df = frame(spark, edges | {(3, 3): 0.9})
    want = plain_components(edges)
    assert dict(map(tuple, cycles.strong_components(df).collect())) == want
    listed = defaultdict(list)
    for r in cycles.cycle_lists(df, longest=5, most=4).orderBy("component", "place").collect():
        listed[r["component"]].append(list(r["cycle"]))
        assert r["length"] == len(r["cycle"])
    known = defaultdict(list)
    for start in range(18):
        todo = [[start]]
        while todo:
            path = todo.pop()
            for a, b in edges:
                if a == path[-1]:
                    if b == start and len(path) > 1:
                        known[want[start]].append((len(path), path))
                    elif b > start and b not in path and len(path) < 5:
                        todo.append([*path, b])
    assert listed == {c: [p for _, p in sorted(found)[:4]] for c, found in known.items()}


def test_no_cycles(spark):
    df = frame(spark, {(a, a + 1): 0.9 for a in range(30)})
    assert cycles.strong_components(df).count() == 0 and cycles.cycle_lists(df).count() == 0
    assert cycles.cycle_lists(df.limit(0)).count() == 0


def test_facts_move_past_no_catcher(spark):
    """A chain of seven functions with a handler in its middle, a cycle, and a caller of everything."""
    chain = [(f"f{i}", f"f{i + 1}", k) for i in range(7) for k in ("throws", "null")] + [("f1", "f3", "throws"), ("f3", "f1", "throws")]
    hot = [(f"user{i}", "f7", "throws") for i in range(500)]
    seeds = spark.createDataFrame([("f7", "throws", "A"), ("f7", "throws", "B"), ("f7", "null", "null"), (None, "throws", "A"), ("f2", "throws", "C")], "node string, fact string, value string")
    ways = spark.createDataFrame(chain + hot, "caller string, callee string, fact string")
    stops = spark.createDataFrame([("f4", "throws", "A"), ("f2", "null", None)], "node string, fact string, value string")
    got = {(r["node"], r["fact"], r["value"]): r["round"] for r in fixpoint.moved(seeds, ways, stops).collect()}
    assert {n for n, f, v in got if (f, v) == ("throws", "A") and n[0] == "f"} == {"f7", "f6", "f5"}
    assert {n for n, f, v in got if (f, v) == ("throws", "B") and n[0] == "f"} == {f"f{i}" for i in range(8)}
    assert {n for n, f, _ in got if f == "null"} == {"f7", "f6", "f5", "f4", "f3"}
    assert got["f1", "throws", "B"] == 5 and got["f0", "throws", "B"] == 6 and got["f3", "throws", "C"] == 2
    assert sum(n.startswith("user") for n, *_ in got) == 1000
    assert {r["round"] for r in fixpoint.moved(seeds, ways, stops, rounds=2).collect()} == {0, 1, 2}


JAVA = """\
class Base {
  protected AuditLog audit;
  void close() { audit.write(1); }
}
class AuditLog {
  void write(int x) { }
}
class OrderDao {
  int find(int id) { return id; }
  void save(int id) { }
}
class FastDao extends OrderDao {
  void save(int id) {
    super.save(id);
  }
}
class OrderService extends Base {
  private final OrderDao dao;
  OrderService(FastDao fast) {
    this.quick = fast;
    var held = fast;
    held.find(1);
    held.save(2);
  }
  void run(int id) {
    dao.find(id);
    this.dao.save(id);
    quick.save(id);
    audit.write(id);
    this.close();
    OrderDao.find(id);
    other.save(id);
    rows.map(id);
  }
}
"""


def test_receivers_of_a_program(spark):
    files = spark.createDataFrame([("a.java", "java", JAVA)], "path string, lang string, content string")
    found = summaries.functions(files)
    fields = spark.createDataFrame([("a.java", "Base", "audit", "AuditLog"), ("a.java", "OrderService", "dao", "OrderDao")], "path string, class string, name string, type string")
    sites = summaries.calls(found)
    pairs = {tuple(r) for r in summaries.receiver_types(found, sites, fields).collect()}
    assert {("a.java::OrderService", "quick", "a.java::FastDao"), ("a.java::OrderService.OrderService", "held", "a.java::FastDao")} <= pairs
    parents = spark.createDataFrame([("a.java::FastDao", "a.java::OrderDao"), ("a.java::OrderService", "a.java::Base")], "class string, parent string")
    imports = spark.createDataFrame([("a.java", "a.java::AuditLog")], "path string, type string")
    got = defaultdict(set)
    for r in summaries.call_edges(found, sites, parents, fields, imports).collect():
        got[r["line"].strip()].add((r["callee"].removeprefix("a.java::"), r["confidence"]))
    assert got["held.find(1);"] == {("OrderDao.find", 0.75)}  # the parameter's type, through an assignment, and its parent's method
    assert got["held.save(2);"] == {("FastDao.save", 0.75)}
    assert got["dao.find(id);"] == {("OrderDao.find", 0.8)} and got["this.dao.save(id);"] == {("OrderDao.save", 0.8)}
    assert got["quick.save(id);"] == {("FastDao.save", 0.8)}
    assert got["audit.write(id);"] == {("AuditLog.write", 0.85)}  # an inherited field of an imported type
    assert got["this.close();"] == {("Base.close", 0.85)}
    assert got["super.save(id);"] == {("OrderDao.save", 0.85)}
    assert got["OrderDao.find(id);"] == {("OrderDao.find", 0.75)}
    assert got["other.save(id);"] == {("FastDao.save", 0.5), ("OrderDao.save", 0.5)}
    assert not got["rows.map(id);"]


CHAIN = "def f0(x):\n    return f1(x)\n\n" + "".join(
    f"def f{i}(x):\n" + ("    try:\n        return f4(x)\n    except ValueError as e:\n        return e\n\n" if i == 3 else f"    return f{i + 1}(x)\n\n") for i in range(1, 6)
) + "def f6(x):\n    if x:\n        raise ValueError(x)\n    if x > 1:\n        raise errors.KeyError(x)\n    return None\n\ndef g(x):\n    y = clean(x)\n    return y\n\ndef clean(x):\n    return escape(read(x))\n\ndef read(x):\n    return input(x)\n\ndef raw(x):\n    z = read(x)\n    return z\n\ndef opener(p):\n    return open(p)\n\ndef user(p):\n    h = opener(p)\n    return h\n\ndef closer(p):\n    h = user(p)\n    h.close()\n\ndef main(p):\n    closer(p)\n"


def test_what_escapes_six_calls(spark):
    files = spark.createDataFrame([("c.py", "python", CHAIN)], "path string, lang string, content string")
    found = summaries.functions(files)
    out = summaries.propagated(summaries.summaries(found), summaries.call_edges(found))
    got = {r["name"]: r for r in out.collect()}
    both = ["KeyError", "ValueError"]
    assert [got[f"f{i}"]["escapes"] for i in range(7)] == [["KeyError"]] * 4 + [both] * 3  # f3 catches one of them
    assert all(got[f"f{i}"]["null_result"] for i in range(7)) and not got["g"]["null_result"]
    assert {n for n, r in got.items() if r["taint_result"]} == {"read", "raw"}
    assert {n for n, r in got.items() if r["held_result"]} == {"opener", "user"}
    assert got["f5"]["throw_result"] and not got["f4"]["throw_result"]  # that one is of direct callees


def test_a_hot_receiver(spark):
    sites = spark.range(2000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"), F.lit("p").alias("path"), F.lit("K").alias("class"), F.lit("self").alias("receiver"), F.lit("go").alias("callee"))
    methods = spark.createDataFrame([("J", "go", "J.go")], "class string, name string, qualified string")
    parents = spark.createDataFrame([("K", "J"), ("J", "K")], "class string, parent string")
    none = spark.createDataFrame([], "scope string, name string, type string")
    got = types.resolve_methods(sites, methods, parents, none)
    assert got.count() == 2000 and {(r["target"], r["confidence"]) for r in got.collect()} == {("J.go", 0.85)}


@pytest.mark.parametrize("dealt", [False, True])
def test_every_method_of_an_unknown_receivers_name(spark, monkeypatch, dealt):
    """only the first three methods of the name were targets."""
    if dealt:
        monkeypatch.setattr(joins, "PAIRS_A_TASK", 20)
        monkeypatch.setattr(joins, "ROWS_A_PART", 2)
    calls = [(f"n{i}", "x", "go") for i in range(9)] + [("own", "self", "go"), ("none", "self", "run"), ("up", "super", "go"), ("odd", "x", "other"), ("null", "x", None), ("field", "y", "go")]
    sites = spark.createDataFrame([(node, None if node == "n3" else "p", "K1", receiver, callee) for node, receiver, callee in calls], "node string, path string, class string, receiver string, callee string")
    methods = [(f"M{i}", "go", f"M{i}.go") for i in range(11)] + [("K0", "go", "K0.go"), ("M1", "run", "M1.run"), ("M2", None, "M2.?")]
    parents = spark.createDataFrame([("K1", "K0")], "class string, parent string")
    known = spark.createDataFrame([("K0", "y", "M7")], "scope string, name string, type string")
    got = types.resolve_methods(sites, spark.createDataFrame(methods, "class string, name string, qualified string"), parents, known)
    assert got.columns == [*sites.columns, "target", "confidence"]
    want = [(f"n{i}", q, 0.5) for i in range(9) for _, name, q in methods if name == "go"] + [("own", "K0.go", 0.85), ("up", "K0.go", 0.85), ("field", "M7.go", 0.8)]
    assert sorted((r["node"], r["target"], r["confidence"]) for r in got.collect()) == sorted(want)


def test_a_class_far_below_another(spark):
    """a class more than 20 below another inherited nothing of it."""
    up = types.ancestors(spark.createDataFrame([(i + 1, i) for i in range(22)], "class long, parent long"))
    assert sorted((r["class"], r["ancestor"], r["hops"]) for r in up.collect()) == sorted((i, j, i - j) for i in range(23) for j in range(i + 1))


def test_intervals_equal_a_range_join(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), lo, lo + rng.randint(-1, 40), n) for n in range(80) for lo in [rng.randint(-30, 100)]] + [("hot", 0, 1 << 40, 900), ("hot", 5, 5, 901), ("hot", None, 4, 902)]
    points = [(rng.choice("abc"), rng.randint(-40, 150), n) for n in range(150)] + [("hot", x, 1000 + x) for x in range(300)] + [("hot", None, 5000)]
    want = {}
    for key, at, p in points:
        around = [(hi - lo, lo, hi, n) for k, lo, hi, n in spans if k == key and lo is not None and at is not None and lo <= at <= hi]
        if around:
            span, lo, hi, n = min(around)
            want[p] = (lo, hi, span, n)
    got = intervals.smallest_enclosing(spark.createDataFrame(points, "k string, at long, p long"), spark.createDataFrame(spans, "k string, lo long, hi long, n long"), ["k"], "at", "p", carry=("n",), ties=("lo", "hi", "n"))
    assert {r["p"]: (r["lo"], r["hi"], r["span"], r["n"]) for r in got.collect()} == want


def test_cover_is_exact_and_small(spark):
    spans = [(lo, hi) for lo in range(-9, 9) for hi in range(lo - 1, 40, 3)]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", intervals.cover(F.col("lo"), F.col("hi"), 6).alias("bins"))
    for r in df.collect():
        inside = [x for b in r["bins"] for x in range(b["bin"] << b["level"], (b["bin"] + 1) << b["level"])]
        assert sorted(inside) == list(range(r["lo"], r["hi"] + 1)) and len(r["bins"]) <= 12
