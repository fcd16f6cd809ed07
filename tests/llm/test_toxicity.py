import itertools
import random
import re
import zlib

import numpy as np

from quarryline.llm import queries, toxicity


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        e, a = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
        ahead, back = toxicity.forward_backward(np.exp(e), np.array([0, n, 0]), np.exp(a))
        odds = ahead * back
        weight = {s: np.exp(sum(x * y for x, y in zip(e, s, strict=True)) + sum(a[p, q] for p, q in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        want = [sum(w for s, w in weight.items() if s[t]) / z for t in range(n)]
        assert np.allclose(odds / (1 + odds), want)


def plain_marginals(e, moves):
    """Forward-backward of one whole chain in logarithms, token by token."""
    n = len(e)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        for j in (0, 1):
            f[t, j] = j * e[t] + (np.logaddexp(f[t - 1, 0] + moves[0, j], f[t - 1, 1] + moves[1, j]) if t else 0)
    for t in range(n - 2, -1, -1):
        for i in (0, 1):
            b[t, i] = np.logaddexp(moves[i, 0] + b[t + 1, 0], moves[i, 1] + e[t + 1] + b[t + 1, 1])
    return 1 / (1 + np.exp((f + b)[:, 0] - (f + b)[:, 1])) if n else np.empty(0)


def test_long_chains_are_whole():
    """Sticky moves carry the state over hundreds of tokens, across all stretches."""
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 64, 65, 128, 1, 1000, 63, 200, 5000])
    for moves in (np.array([[4.0, -4.0], [-4.0, 4.0]]), np.array([[-3.0, 3.0], [3.0, -3.0]]), rng.normal(0, 1, (2, 2))):
        e = rng.normal(0, 1, sizes.sum())
        e[rng.random(len(e)) < 0.02] = 30
        ahead, back = toxicity.forward_backward(np.exp(e), sizes, np.exp(moves))
        odds = ahead * back
        ends = np.cumsum(sizes)
        for got, part in zip(np.split(odds / (1 + odds), ends[:-1]), np.split(e, ends[:-1]), strict=True):
            assert np.allclose(got, plain_marginals(part, moves), atol=1e-9)


def test_parts_cover_all_documents():
    sizes = np.array([0, 5, 0, 7, 300, 1, 0, 2, 0])
    for step in (1, 6, 1000):
        parts = toxicity._parts(sizes, step)
        assert [t for s, e, _ in parts for t in range(s, e)] == list(range(sizes.sum()))
        assert all(g.sum() == e - s for s, e, g in parts)


def texts(n, rng):
    plain = [f"w{i}" for i in range(200)]
    bad = ["vileword", "nastything", "crudo", "RÉPUGNA"]
    rows = []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 150))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ly", "s", "."]))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(6)
    chain = toxicity.fit(texts(500, rng))
    test = texts(200, rng)
    rows = [(i, t, "clash") for i, (t, _) in enumerate(test)]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), chain).collect()}
    right = sum((out[i].score >= 0.7) == bool(y) for i, (_, y) in enumerate(test))
    assert right >= 0.97 * len(test)
    stems = ("vileword", "nastything", "crudo", "répugna")
    for i, (t, y) in enumerate(test):
        for s in out[i].spans:
            assert 0 <= s.start < s.end <= len(t)
            if y:
                assert any(x in t[s.start : s.end].lower() for x in stems)


def test_token_counts_agree():
    for t in ["Ab-cd É K x_y İstanbul 12.5", "", "é", "\x00a\x7fb", "ΑΣ ßẞ"]:
        assert len(toxicity.tokens_of(t)) == len(toxicity._TOKEN.findall(t))


def test_long_texts_nulls_and_empty(spark):
    chain = toxicity.fit(texts(300, random.Random(2)))
    rows = [(None, "vileword"), (1, None), (2, ""), (3, "w1 " * 30_000 + "vileword nastything crudo"), (3, "w1"), (3, "w1")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert [(r.spans[0].start, r.spans[-1].end) for r in out if len(r.spans)][-1][1] >= 8
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), chain).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    none = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert all(r.score < 0.01 for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), none).collect())


def plain_score(chain, text):
    words = [w.encode() for w in re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), (text or "").lower()))]
    own = []
    for w in words:
        u = w.decode()
        own.append(sum(chain.own.get(f, 0) for f in [b"=" + w, *(b"^" + u[:n].encode() for n in range(4, 10) if len(u) >= n)]))
    e = [own[i] + chain.bias + (chain.left.get(b"=" + words[i - 1], 0) if i else 0) + (chain.right.get(b"=" + words[i + 1], 0) if i + 1 < len(words) else 0) for i in range(len(words))]
    p = plain_marginals(np.clip(e, -30, 30), chain.moves)
    total, sure = sum(p), sum(x > 0.5 for x in p)
    x = [1, np.log1p(total), max(p, default=0), np.log1p(sure), total / max(20, len(p)) * 10, np.log1p(len(p))]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, chain.document), -30, 30)))


def test_scores_match_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, chain, with_spans=False).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert abs(got[r.doc_id] - plain_score(chain, r.text)) < 1e-6


def test_training_descends_the_likelihood():
    """The gradient's zero: at the trained weights expected and labelled state counts agree but for the ridge."""
    rng = random.Random(4)
    rows = texts(200, rng)
    docs = [toxicity.tokens_of(t) for t, _ in rows]
    y = np.array([x for _, x in rows])
    chain = toxicity.fit_chain(docs, y)
    of, _, marked = toxicity.token_labels(docs, y)
    labelled = sum(w in marked for d, t in zip(docs, y, strict=True) if t for w in d)
    expected = sum(p.sum() for p in toxicity.Tagger(chain).marginals(docs))
    assert labelled and abs(expected - labelled) < 0.1 * labelled


def test_query_on_its_table(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in out.items())
    held = [(r.toxic, out[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_held_out_labels_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    from quarryline.llm.common import crc32_mod

    other = labels.withColumn("toxic", F.when(crc32_mod(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, other))
    assert a.own == b.own and np.array_equal(a.document, b.document)
