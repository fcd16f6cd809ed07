"""What keeps work in step with its input: equal texts, few-byte tables, small broadcasts."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import both
from pyspark.sql import functions as F

from quarryline import session
from quarryline.operators import code, cycles, fixpoint, intervals, line_rules, summaries, triage, types
from quarryline.plans import catalog, scan_queries
from quarryline.plans.code_fixtures import FIXTURES
from quarryline.plans.code_queries import files_of, projects_of
from quarryline.sources.tables import table


def test_a_table_of_one_file_makes_projects_in_many_tasks(spark, sf_dir):
    """a supplier table of few bytes was one task, whatever its projects cost."""
    texts = [("a.py", "python", "x = 1"), ("b.go", "go", "package b")]
    t = lambda name: table(spark, sf_dir, name)
    for files, n in ((projects_of(t, texts), 2 * t("supplier").count()), (files_of(t, texts, "part", "p_partkey"), t("part").count())):
        assert files.count() == n
        assert files.select(F.spark_partition_id()).distinct().count() > 1


def test_equal_texts_are_read_once_a_task(spark):
    """each copy was parsed again, and each file's rows were a batch of their own."""
    reads = spark.sparkContext.accumulator(0)

    def rows_of(text, lang):
        reads.add(1)
        return [(lang, i, c) for i, c in enumerate(text)]

    texts = ["ab", None, "", "abc"]
    files = spark.range(4000).coalesce(1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 8 < 4, "x").alias("lang"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("content"))
    got = sorted(map(tuple, code.per_file(files, "path string, lang string, n int, c string", rows_of).collect()))
    assert got == sorted((str(i), "x" if i % 8 < 4 else None, n, c) for i in range(4000) for n, c in enumerate(texts[i % 4] or ""))
    assert reads.value == 8


def _small_broadcasts(spark):
    """Refuses broadcasts of more than 48 MB, as a small driver does; a page of one takes up to 32."""
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48MB")
    return lambda: spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def test_names_and_receivers_are_typed_without_large_broadcasts(spark):
    """fronts of up to 500,000 rows, and written tables that compress well, went through the driver."""
    n = 450_000
    text = lambda prefix, c=F.col("id"): F.concat(F.lit(prefix), c.cast("string"))
    ids = spark.range(n)
    declared = ids.select(text("o").alias("scope"), F.lit("v0").alias("name"), text("c", F.col("id") % 1000).alias("type"))
    assigned = ids.select(text("o").alias("scope"), F.lit("v1").alias("name"), text("o").alias("from_scope"), F.lit("v0").alias("from_name"))
    methods = spark.range(1000).select(text("c").alias("class"), F.lit("go").alias("name"), text("go").alias("qualified"))
    parents = spark.createDataFrame([], "class string, parent string")
    sites = ids.select(text("o").alias("node"), F.lit("a.py").alias("path"), F.lit(None).cast("string").alias("class"), F.lit("v1").alias("receiver"), F.lit("go").alias("callee"))
    restore = _small_broadcasts(spark)
    try:
        found = types.name_types(declared, assigned)
        assert found.count() == 2 * n
        got = types.resolve_methods(sites, methods, parents, found)
        assert got.count() == n
        assert got.where("target = concat('go', cast(substr(node, 2) as int) % 1000) and confidence = 0.75").count() == n
    finally:
        restore()


def test_facts_move_without_large_broadcasts(spark):
    """each round's front was broadcast whole, up to 500,000 rows."""
    n = 450_000
    seeds = spark.range(n).select((2 * F.col("id")).alias("node"), F.lit("throws").alias("fact"), F.lit("ValueError").alias("value"))
    ways = spark.range(n).select((2 * F.col("id") + 1).alias("caller"), (2 * F.col("id")).alias("callee"), F.lit("throws").alias("fact"))
    stops = spark.range(n).where("id % 3 = 0").select((2 * F.col("id") + 1).alias("node"), F.lit("throws").alias("fact"), F.when(F.col("id") % 2 == 0, "ValueError").alias("value"))
    restore = _small_broadcasts(spark)
    try:
        got = fixpoint.moved(seeds, ways, stops)
        assert got.where("round = 0").count() == n
        assert got.where("round = 1 and node % 6 <> 1").count() == got.where("round > 0").count() == n - n // 3
    finally:
        restore()


@pytest.mark.parametrize("seconds", [[0.6, 86400.2], [0.4, 86399.5, 86400.3], [1.5, 2.5, 86402.0], [i * 199.5 * 86400 / 56 for i in range(57)], [0.0]])
def test_churn_counts_days_and_rounds_as_its_sql(spark, tmp_path, seconds):
    """fractions of seconds were dropped for both columns, and 57 / 200 became 0.29 for 0.28."""
    pq.write_table(pa.table({"event_id": range(len(seconds)), "ts": pa.array([round(x * 1e6) for x in seconds], pa.timestamp("us"))}), tmp_path / "events.parquet")
    got, want = both(spark, str(tmp_path), catalog.QUERIES["churn_per_day"], catalog.ORACLES["churn_per_day"])
    assert got == want


def test_few_intervals_of_a_key_need_no_bins(spark, monkeypatch):
    """bins, up to two of each size for every interval, were written even where a key has two or three intervals."""
    rows = spark.range(5000)
    spans = rows.select(F.floor(F.col("id") / 4).alias("k"), (F.col("id") % 4 * 10).alias("lo"), (F.col("id") % 4 * 10 + 15).alias("hi"))
    hot = rows.select(F.lit(-1).cast("long").alias("k"), F.col("id").alias("lo"), (F.col("id") + F.col("id") % 7).alias("hi"))
    odd = spark.createDataFrame([(None, 0, 9), (1, None, 9), (1, 0, None)], "k long, lo long, hi long")
    points = rows.select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") % 1300).alias("k"), (F.col("id") % 50).alias("at")).unionByName(spark.createDataFrame([(9001, None, 3), (9002, 1, None)], "id long, k long, at long"))
    find = lambda s: sorted(map(tuple, intervals.smallest_enclosing(points, s, ["k"], "at", "id").collect()))
    mixed = find(spans.unionByName(hot).unionByName(odd))
    monkeypatch.setattr(intervals, "FEW", 0)
    assert find(spans.unionByName(hot).unionByName(odd)) == mixed and len(mixed) > 4000
    monkeypatch.setattr(intervals, "FEW", 32)
    monkeypatch.setattr(intervals, "cover", None)
    assert len(find(spans)) > 3000


def test_texts_are_searched_once_a_pattern(spark):
    """Each group of a pattern was a search of its own, and a filter that Spark puts before an explode searched again."""
    import re

    bodies = ["def f(a: User, b : int):\n    self.x = User(1)\n    y = x\n    this.z := other // c\n    a.go(); Shop . run(b)\n", "void g(User u, List<User> v) {\n  Shop s = new Shop(u);\n  s.go(User x=3);\n  t = s;\n}", "", "x = y", "A: B c;\nnew File  (1) if (a->b (c)::d()) 'q' \"r\"(e())"]
    rows = [(f"p{i}::f", f"p{i}", ["", "K"][i % 2], 1, 0, b) for i, b in enumerate(bodies)]
    found = spark.createDataFrame(rows, "node string, path string, owner string, start_line int, head_lines int, body string")
    declared, assigned = types.declarations(found)
    searched = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")
    assert searched(declared) == 2 and searched(assigned) == 1 and searched(summaries.calls(found)) == 1
    scope = lambda n, i: f"p{i}::{rows[i][2]}" if n.startswith(("self.", "this.")) else f"p{i}::f"
    bare = lambda n: re.sub("^(self|this)[.]", "", n)
    named = lambda: ((i, m) for i, b in enumerate(bodies) for m in [(a or d, t or c) for a, t, c, d in re.findall(types._DECLARED + types._BEFORE, b)] + re.findall(types._MADE, b))
    assert {tuple(r) for r in declared.collect()} == {(f"p{i}", scope(n, i), bare(n), t) for i, (n, t) in named()}
    assert {tuple(r) for r in assigned.collect()} == {(scope(n, i), bare(n), scope(o, i), bare(o)) for i, b in enumerate(bodies) for n, o in re.findall(types._COPIED, b)}
    called = {(i, at + 1, r, c) for i, b in enumerate(bodies) for at, line in enumerate(b.split("\n")) if len(re.findall("[\"']", line)) < 4 for r, c in re.findall(summaries.CALL, line) if c not in summaries.NOT_CALLED}
    assert {(int(r["path"][1:]), r.line_no, r.receiver, r.callee) for r in summaries.calls(found).collect()} == called and len(called) == 7


def test_only_asked_files_of_classes_are_parsed(spark, sf_dir):
    """all seven texts of each project were parsed for the classes of one."""
    plan = catalog.QUERIES["inheritance_depth"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("MapInArrow") < plan.index("EndsWith(")


def test_components_need_no_large_broadcasts(spark):
    """fronts, colours and edges that compress well went through the driver whole."""
    n = 600_000
    pairs = spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("caller"), F.concat(F.lit("n"), (F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).cast("string")).alias("callee"))
    restore = _small_broadcasts(spark)
    try:
        got = cycles.strong_components(pairs)
        assert got.count() == n and got.select("component").distinct().count() == n // 2
    finally:
        restore()


def test_lines_are_packed_in_more_tasks_where_there_are_more(spark, sf_dir, monkeypatch):
    """as many tasks as the session names sorted all lines, however many there were."""
    monkeypatch.setattr(scan_queries, "ROWS_A_TASK", 100)
    parts = table(spark, sf_dir, "lineitem").count() // 100
    plan = catalog.QUERIES["packed_lines"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert parts > 16 and plan.count(f"], {parts}") == 3


def test_rules_are_told_apart_only_on_lines_that_may_hit(spark, monkeypatch):
    """every line was held against each expression of its language, one by one."""
    texts = {line for f in FIXTURES for text in (f[2], f[4]) for line in text.split("\n")} | {"", " ", "}", "password = 'kf93!xpA2'", "db.token = kf93!xpA2", '"pwd" := "kf93!xpA2"', "new String(cutBytes, 0, most);"}
    langs = [*line_rules.patterns_of(), None, "unknown"]
    rows = spark.createDataFrame([(str(i), lang, i, line) for i, line in enumerate(sorted(texts)) for lang in langs] + [("null", "java", 0, None)], "path string, lang string, line_no int, line string")
    plan = line_rules.line_hits(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Filter CASE WHEN")
    got = sorted(map(tuple, line_rules.line_hits(rows).collect()))
    assert rows.where(line_rules.may_hit()).count() < rows.count() / 4
    monkeypatch.setattr(line_rules, "may_hit", lambda: F.lit(True))
    assert got == sorted(map(tuple, line_rules.line_hits(rows).collect())) and {r[1] for r in got} == {c[0] for c in line_rules.CHECKS} | {"HARDCODED-PASSWORD", "CONFIG-HARDCODED-SECRET"}


def test_one_file_of_many_intervals_is_dealt_by_rows(spark, monkeypatch):
    """two tasks, one a split of a file of few bytes, sorted the bins of all parts of one file; a written table was broadcast by its compressed bytes."""
    n, a_task = 24_000, 1_000
    rows = spark.range(n).coalesce(1)
    name = lambda i: F.element_at(F.array(*map(F.lit, ["cache_a", "token_b", "pick_c", "load_d"])), (i % 4 + 1).cast("int"))
    blocks = rows.select(F.lit("f").alias("path"), F.lit("function").alias("kind"), name(F.col("id")).alias("name"), (10 * F.col("id")).cast("int").alias("start_line"), (10 * F.col("id") + 8).cast("int").alias("end_line"))
    hits = rows.select(F.lit("f").alias("path"), F.lit("WEAK-HASH").alias("rule_id"), (10 * F.col("id") + F.col("id") % 10).cast("int").alias("line_no"))
    sizes = []

    def written(df, tag):
        out = session.materialize(df, tag)
        if tag in ("interval-index", "enclosed"):
            sizes.append((tag, [r[0] for r in out.groupBy(F.input_file_name()).count().select("count").collect()]))
        return out

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    find = lambda: sorted(r.line_no for r in triage.in_context(hits, blocks).select("line_no").collect())
    want = sorted(10 * i + i % 10 for i in range(n) if i % 10 == 9 or i % 4 in (1, 3))
    assert find() == want
    monkeypatch.setattr(session, "ROWS_A_TASK", a_task)
    monkeypatch.setattr(intervals, "materialize", written)
    monkeypatch.setattr("quarryline.operators.joins.SMALL_ROWS", a_task)
    assert find() == want and before == {k: spark.conf.get(k) for k in before}
    assert [tag for tag, _ in sizes] == ["interval-index", "enclosed"]
    assert all(len(files) == n // a_task and max(files) < 3 * sum(files) / len(files) for _, files in sizes)
    plan = triage.in_context(hits, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and "LeftOuter, BuildRight" not in plan
