import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from quarryline.llm import langid, queries
from quarryline.llm.common import crc32_mod

WORDS = {"aa": "the of and thing", "bb": "der und nicht über", "cc": "le été vous où", "dd": "日本 語 の は"}


def texts(n, rng):
    return [(" ".join(rng.choice(WORDS[k].split()) for _ in range(rng.randrange(1, 30))), k) for k in WORDS for _ in range(n)]


def test_held_out_accuracy_and_calibration():
    rng = random.Random(1)
    model = langid.fit(texts(80, rng))
    got = [(model.predict(t), k) for t, k in texts(50, rng)]
    assert np.mean([p[0] == k for p, k in got]) >= 0.97
    assert (model.weights == 0).mean() > 0.9  # sparse
    assert model.temperature > 0


def test_temperature_is_the_best():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    z = np.eye(3)[y] * 2 + rng.gumbel(size=(4000, 3))
    base = langid.calibrate(z, y)
    assert np.isclose(langid.calibrate(z * 5, y), base * 5, rtol=1e-3)


def test_counts_do_not_depend_on_steps():
    text = "Grüße, мир! " * 500
    a, b = langid.gram_counts(text), langid.gram_counts(text, step=17)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_edges(spark):
    model = langid.fit(texts(60, random.Random(1)))
    rows = [(1, None), (2, ""), (3, "123 !! ..."), (None, "the of and"), (4, "the of and"), (4, "the of and"), (5, "der und " * 40_000)]
    out = langid.predict(spark.createDataFrame([(i, t, "cc") for i, t in rows], "doc_id long, text string, lang_pred string"), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in out if r.lang_pred == "und"] == [(1, "und"), (2, "und"), (3, "und")]
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id == 5} == {"bb"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert langid.fit([]).predict("abc") == ("und", 0.0)


def test_query_on_its_table(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op6_langid(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    assert all(out[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if out[d.doc_id].held_out and d.lang and langid.has_letter(d.text)]
    assert np.mean([out[d.doc_id].lang_pred == d.lang for d in held]) >= 0.97


def plain_counts(text):
    """Columns of single, double and triple characters, one at a time."""
    mask, points = 2**64 - 1, [ord(c) for c in " " + re.sub(r"\s+", " ", text.lower()) + " "]
    out = Counter()
    for i in range(len(points)):
        value = 0
        for n in range(1, 4):
            if i + n > len(points):
                break
            value = (value + points[i + n - 1] + n) * 0x9E3779B97F4A7C15 & mask
            value ^= value >> 29
            out[(value * 0xBF58476D1CE4E5B9 & mask) >> 48] += 1
    return out


def plain_predict(model, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = {c: (1 + math.log(n)) * model.idf[c] for c, n in plain_counts(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [(sum(float(model.weights[k, c]) * v for c, v in x.items()) / norm + model.bias[k]) / model.temperature for k in range(len(model.langs))]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(z)), key=lambda k: z[k])
    return model.langs[best], e[best] / sum(e)


def test_query_matches_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(crc32_mod(docs["doc_id"], 5) != 0))
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_langid(spark, sf_dir).collect()}
    for r in docs.collect():
        lang, score = plain_predict(model, r.text)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-6


def test_training_matches_a_plain_version():
    """The regularised leader, one coordinate at a time, over the same order of rows."""
    rng = random.Random(3)
    rows = texts(6, rng)
    model = langid.Model(sorted(WORDS), np.ones(langid.DIMS), np.zeros((4, langid.DIMS), np.float32), np.zeros(4))
    x, y = [model.row(t) for t, _ in rows], np.array([model.langs.index(k) for _, k in rows])
    got = langid.ftrl(x, y, 4, epochs=2, seed=7)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k, c):
        if abs(z[k, c]) <= 0.02:
            return 0.0
        return -(z[k, c] - math.copysign(0.02, z[k, c])) / ((1 + math.sqrt(n[k, c])) / 0.5 + 0.02)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            entries = [*zip(x[i][0].tolist(), x[i][1].tolist(), strict=True), (langid.DIMS, 1.0)]
            s = [sum(weight(k, c) * v for c, v in entries) for k in range(4)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(4):
                for c, v in entries:
                    g, w = (e[k] / sum(e) - (k == y[i])) * v, weight(k, c)
                    z[k, c] += g - (math.sqrt(n[k, c] + g * g) - math.sqrt(n[k, c])) / 0.5 * w
                    n[k, c] += g * g
    want = np.zeros_like(got)
    for k, c in list(z):
        want[k, c] = weight(k, c)
    assert np.allclose(got, want, atol=1e-9) and np.abs(want).max() > 0.1
