import hashlib
import random
import re

import numpy as np
import pytest

from quarryline.llm import linededup, queries


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=10):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key_of(line)) >= min_chars:
                held.setdefault(key_of(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key_of(x), ())) < 2 or min(held[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def fixture_rows():
    rng = random.Random(5)
    pool = ["A common line of text", "a COMMON line of text  ", "\tshort", "éééééééééé", "ééééééééé", "x" * 9, "X" * 10, "", "   ", "line with\ttab inside"]
    pool += [f"rare line number {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n\n"), (83, "only here, twice\nonly here, twice"), (None, "A common line of text\nno id"), (7, rows[7][1]), (84, "\n".join(f"long text line {i % 700}" for i in range(20_000)))]
    return rows


@pytest.mark.parametrize("setting", [{}, {"broadcast_bytes": 0}, {"max_cells": 1 << 20, "broadcast_bytes": 0}])
def test_matches_brute_force(spark, setting):
    rows = fixture_rows()
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_lines int, low string")
    out = linededup.line_dedup(df, **setting).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out), key=str) == brute(rows)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_hot_lines_are_dropped_apart(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "HOT", 5)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", few)
    rows = fixture_rows()
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=0).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out), key=str) == brute(rows)


def test_packed_cells():
    rng = random.Random(1)
    for cells in ([], [0], [255], [254, 255, 256, 510, 511, 10**6], sorted(rng.sample(range(linededup.SEGMENT), 5000))):
        data = linededup.packed(np.array(cells, np.int64))
        assert linededup.unpacked(data).tolist() == cells
    assert len(data) < 2 * 5000 + linededup.SEGMENT // 255


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SEGMENT", 1 << 6)
    rows = fixture_rows()
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_cells=1 << 8).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out), key=str) == brute(rows)


def test_empty(spark):
    assert linededup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = queries.op9_line_dedup(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out), key=str) == brute([(r.doc_id, r.text) for r in docs])


def test_query_matches_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = con.sql(queries.ORACLES["op9_line_dedup"]).project(", ".join(columns)).fetchall()
    assert sorted(tuple(r) for r in queries.op9_line_dedup(spark, sf_dir).select(columns).collect()) == sorted(want)
