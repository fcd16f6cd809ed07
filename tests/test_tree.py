import os

from pyspark.sql import functions as F

from quarryline.sources import files, tree


def made(root, names):
    for name, content in names.items():
        at = os.path.join(root, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(content)


NAMES = {
    "a.py": b"x = 1\n", "src/b.py": b"y = 2\n", "src/deep/er/c.go": b"package c\n", "src/big.py": b"#" * 5000, "src/gen.py": b"# Generated by the protocol buffer compiler.  DO NOT EDIT!\n",
    "src/bin.py": b"\x00\x01", "node_modules/d.py": b"z", "src/node_modules/x/e.py": b"z", ".venv/f.py": b"z", ".github/g.py": b"w = 3\n", "src/h_pb2.py": b"z", "docs/i.py": b"z", "src/[odd] name.py": b"v = 4\n", "src/j.txt": b"t",
}


def test_same_files_as_the_scan_of_any_store(spark, tmp_path):
    made(tmp_path, NAMES)
    want = sorted(map(tuple, files.scan(spark, str(tmp_path)).collect()))
    assert sorted(map(tuple, tree.scan(spark, str(tmp_path)).collect())) == want
    assert {p for p, _, _ in want} == {"a.py", "src/b.py", "src/deep/er/c.go", "src/big.py", ".github/g.py", "src/[odd] name.py"}
    changed = spark.createDataFrame([("src/b.py",), ("gone.py",)], "path string")
    assert [r.path for r in tree.scan(spark, "file://" + str(tmp_path), changed=changed).collect()] == ["src/b.py"]
    assert sorted(r.path for r in tree.scan(spark, str(tmp_path), exclude=["*big*"], only=["python"]).collect()) == [".github/g.py", "a.py", "src/[odd] name.py", "src/b.py"]


def test_addresses_in_batches(spark, tmp_path, monkeypatch):
    made(tmp_path, NAMES)
    want = sorted(map(tuple, files.scan(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(files, "ADDRESSES", 2)
    assert sorted(map(tuple, files.scan(spark, str(tmp_path)).collect())) == want


def test_filters_are_pushed(spark, tmp_path):
    made(tmp_path, NAMES)
    rows = tree.tree(spark, str(tmp_path)).where(F.col("lang").isin("python", "go") & (F.col("size") > 5) & (F.col("size") <= 100) & F.col("path").startswith("src/"))
    assert sorted(r.path for r in rows.collect()) == ["src/[odd] name.py", "src/b.py", "src/deep/er/c.go", "src/gen.py"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # all of it is done by the source


def test_skipped_folders_and_refused_files_stay_closed(spark, tmp_path):
    made(tmp_path, NAMES | {"src/closed/x.py": b"1"})
    reader = tree.TreeReader(str(tmp_path), 3, True)
    seen = []
    own, reader._list = reader._list, lambda folder: seen.append(folder) or own(folder)
    reader.prefix, reader.langs = "src/d", {"go"}
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["src/deep/er/c.go"]
    assert set(seen) == {"", "src/", "src/deep/", "src/deep/er/"}


def test_partitions_cover_a_tree_once(tmp_path):
    made(tmp_path, {f"p{i}/q{j}/r.py": b"1" for i in range(5) for j in range(7)} | {"flat/" + f"{i}.py": b"1" for i in range(30)} | {"top.py": b"1"})
    for tasks in (1, 2, 5, 50):
        reader = tree.TreeReader(str(tmp_path), tasks, False)
        got = [r[0] for p in reader.partitions() for r in reader.read(p)]
        assert len(got) == len(set(got)) == 66


def test_empty_tree(spark, tmp_path):
    assert tree.scan(spark, str(tmp_path)).count() == 0


def test_files_come_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    """Spark gathered 10,000 files of a task, whatever their size, and a folder's entries were listed whole."""
    made(tmp_path, {f"p/{i}.py": bytes([97 + i % 26]) * (i * 10) for i in range(100)} | {"p/large.py": b"x" * 9_000, "p/empty.py": b""})
    plain = tree.TreeReader(str(tmp_path), 1, True)
    want = sorted(r for p in plain.partitions() for r in plain.read(p))
    monkeypatch.setattr(tree, "BATCH_BYTES", 4_000)
    reader = tree.TreeSource({"root": str(tmp_path), "tasks": "1"}).reader(None)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 12 and all(b.num_rows == 1 or sum(map(len, b.column(4).to_pylist())) <= 4_000 for b in batches)
    assert sorted((r["path"], r["lang"], r["size"], r["content"]) for b in batches for r in b.to_pylist()) == [(p, lang, n, c) for p, lang, n, _, c in want]
    assert not isinstance(plain._list("p/")[1], list) and len(list(plain._list("p/")[1])) == 102
    got = {r.path: (r.modified_s, r.size, bytes(r.content)) for r in tree.tree(spark, str(tmp_path)).select("*", F.unix_micros("modified").alias("modified_s")).collect()}
    assert {k: v[1:] for k, v in got.items()} == {p: (n, c) for p, _, n, _, c in want}
    assert all(abs(got[p][0] / 1e6 - m.timestamp()) < 1e-3 for p, _, _, m, _ in want)
    assert all(r.content is None for r in tree.tree(spark, str(tmp_path), content=False).collect())
