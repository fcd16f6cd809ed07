import hashlib
import random
import re

import numpy as np
import pytest

from quarryline.llm import queries, winnow


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        ws = words(t)
        n = min(window, len(ws))
        for p in range(len(ws) - n + 1 if ws and i is not None else 0):
            windows.setdefault(tuple(ws[p : p + n]), set()).add(i)
    out = []
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(ws) - n + 1):
                if got := windows.get(tuple(ws[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnow.with_digest(df).collect()), key=str)


def fixture():
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "été", "x1"]) + str(rng.randrange(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 4, 9, 10, 11, 12, 30, 30, 60, 200])]
    items += [(100, items[8][1]), (101, None), (None, items[9][1]), (102, "a a a a a a a a a a a a"), (103, "... !!!"), (9, items[9][1])]
    docs = []
    for i in range(150):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            ws = words(rng.choice(items)[1])
            lo = rng.randrange(0, len(ws) + 1)
            at = rng.randrange(0, len(parts) + 1)
            parts[at:at] = ws[lo : lo + rng.choice([3, 9, 10, 11, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(parts)))
    docs += [(200, None), (201, ""), (202, "A " * 25), (3, docs[3][1]), (None, items[10][1]), (203, " ".join(word() for _ in range(20_000)) + " " + items[11][1])]
    return docs, items


@pytest.fixture(params=["broadcast", "joined"])
def size(request, monkeypatch):
    """With a bound of few words the benchmark counts as large and stays in the cluster."""
    if request.param == "joined":
        monkeypatch.setattr(winnow, "BROADCAST_WORDS", -1)


def test_matches_brute_force(spark, size):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    want = brute(docs, items)
    assert got(winnow.decontaminate(d, b)) == want
    clean = winnow.uncontaminated(d, b)
    assert clean.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None) == sorted((i, t) for i, t in docs if i is not None and not brute([(i, t)], items)[0][-1])


def test_guarantee():
    """Any shared span of w + k - 1 words holds a common fingerprint."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(6, 40))
        hashes = rng.integers(0, 9, n).astype(np.uint64)
        at = winnow.winnow(hashes, 6)
        assert all(((at >= i) & (at < i + 6)).any() for i in range(n - 5))


def test_empty(spark, size):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert winnow.decontaminate(none, items).count() == 0
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert got(winnow.decontaminate(docs, items)) == brute([(1, "one two")], [])


def test_query_on_its_table(spark, sf_dir):
    rows = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()]
    out = queries.op10_winnow(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=str) == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
