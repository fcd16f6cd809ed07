import random
import re
from collections import Counter, defaultdict

from oracle import connect

from quarryline.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    """Every share of every term, in Python integers."""
    docs = [(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), lang or "", source or "") for _, t, lang, source in rows]
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, source) for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held = Counter(w for t, g, _ in docs if g == lang for w in set(t))
        kept = {w for w, n in held.items() if n >= least}
        counts = defaultdict(Counter)
        for t, g, s in docs:
            if g == lang:
                counts[s].update(w for w in t if w in kept)
        total = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        q = share(total)
        shares = {s: share(c) for s, c in counts.items()}
        for s, p in shares.items():
            pair = [(sum((p[w] - o[w]) ** 2 // o[w] for w in kept), other) for other, o in shares.items() if other != s]
            own = [((p[w] - q[w]) ** 2 // q[w], w) for w in kept if counts[s][w] and p[w] > q[w]]
            for part, found in (("pair", pair), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def audited(spark, rows, **more):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), **more).collect())


def test_equals_plain_version(spark):
    rng = random.Random(1)
    words = ["the", "The", "of", "été", "Ünd", "x1y", "naïve", "zz", "日本", "a-b", "it's"]
    rows = [(n, " ".join(rng.choices(words, range(11, 0, -1), k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for n in range(80)]
    rows += [(90, None, "en", "silent"), (91, "12 34", "de", "x"), (92, "", "de", "y"), (93, "one two", "solo", "z"), (94, "of " * 50_000, "en", "long"), (0, "the of zz", "en", "a"), (None, "the of zz", "en", "a")]
    assert audited(spark, rows) == plain(rows)
    assert audited(spark, rows, least_docs=1, top=3) == plain(rows, 1, 3)


def test_extremes_stay_in_range(spark):
    """One kept term, all counts on one side: shares of 1 and of 10^9."""
    rows = [(n, "w " * 3000, "en", "big") for n in range(3)] + [(9, "", "en", "none"), (8, "other", "en", "tiny")]
    assert audited(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert audited(spark, []) == []
    rows = [(n, "same words here", "en", s) for n, s in enumerate("aabbcc")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as value", "2 as term", "3 as `a.b`")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(rows)


def test_terms_handed_on_in_parts(spark):
    """Sources joined by salted copies give the same rows as by broadcast."""
    from quarryline.operators import joins

    rows = [(n, " ".join(f"t{n % 7} w{n % 3} all".split()), "en", f"s{n % 5}") for n in range(60)]
    want, held = plain(rows), joins.BROADCAST_ROWS
    joins.BROADCAST_ROWS = 0
    try:
        assert audited(spark, rows) == want
    finally:
        joins.BROADCAST_ROWS = held


def test_sql_equals_plain_version(tmp_path, spark):
    rows = [(n, f"alpha beta {'gamma' * (n % 3)} Delta", "en", f"s{n % 4}") for n in range(20)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in connect(str(tmp_path)).sql(divergence.ORACLE).fetchall())
    assert got == plain(rows)
