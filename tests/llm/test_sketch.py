import hashlib
import random
import re
import struct

import xxhash

from quarryline.llm import queries, sketch


def signed(x, bits):
    return x - (1 << bits) if x >> (bits - 1) else x


def chain(hashes):
    """Spark's xxhash64 of several longs: each one's hash is the next one's seed."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", signed(h, 64)), seed=seed)
    return seed


def brute_sketch(text, fraction=sketch.FRACTION):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    hs = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    runs = [chain(hs[i : i + 5]) for i in range(len(hs) - 4)] if len(hs) >= 5 else [chain(hs)] if hs else []
    values = {signed(r >> 32, 32) for r in runs}
    return sorted(v for v in values if v < -(2**31) + fraction * 2**32) or sorted(values)[:1]


def near(a, b):
    small = min(len(a), len(b))
    return float(len(a) == len(b)) if not small else len(set(a) & set(b)) / small


def printed(s):
    return "".join(f"{v & 0xFFFFFFFF:08X}" for v in s)


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t)
    order = sorted(texts, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    out = []
    for i, t in rows:
        cut = len(t) // 3
        head = min(texts[after[i]], key=str.encode) if i is not None else ""
        edited = t[: len(t) - cut] + head[:cut]
        a, b = brute_sketch(t), brute_sketch(edited)
        nxt = min(map(brute_sketch, texts[after[i]])) if i is not None else None
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), near(a, b), near(a, nxt) if nxt is not None else 0.0))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "Beta", "été", "日本", "x"]) + str(rng.randrange(50))
    rows = [(rng.randrange(10**12), " ".join(word() for _ in range(rng.randrange(0, 90)))) for _ in range(60)]
    rows += [(-5, None), (-6, ""), (-7, "a"), (-8, "a b"), (-9, "\n\t "), (None, "some words here and there again"), (-10, "Q" * 50_000), (-11, " ".join(word() for _ in range(20_000)))]
    rows += [rows[0], (rows[1][0], "another text of the same id"), (10**13, rows[2][1])]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, sketch string, taker int")
    assert sorted((tuple(r) for r in sketch.fingerprints(df).collect()), key=str) == brute(rows)


def test_merge_and_containment(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:800])), (3, " ".join(base[:400] + [f"v{i}" for i in range(400)]))]
    df = spark.createDataFrame(rows, "i int, t string").select("i", sketch.sketch(F.col("t")).alias("s"))
    got = {r.i: list(r.s) for r in df.collect()}
    pair = spark.createDataFrame([(got[1], got[2], got[3])], "a array<int>, b array<int>, c array<int>")
    row = pair.select(sketch.containment(F.col("a"), F.col("b")).alias("ab"), sketch.containment(F.col("a"), F.col("c")).alias("ac"), sketch.merged(F.col("b"), F.col("c")).alias("m")).first()
    assert row.ab == 1.0 and abs(row.ac - 0.5) < 0.12
    assert list(row.m) == sorted(set(got[2]) | set(got[3]))


def test_single_and_empty(spark):
    one = sketch.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == brute([(1, "abcdef")])
    assert sketch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in queries.op4_sketch(spark, sf_dir).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs])
