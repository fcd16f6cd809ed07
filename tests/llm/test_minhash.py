import random
import re
from fractions import Fraction

from quarryline.llm import minhash, queries

SCHEMA = "doc_id long, text string, lang string, kept string, component_id string"


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    """All pairs, then the smallest reachable id."""
    sets = {i: sets_of(t, n) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def fixture_rows():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "oNE\ttwo"), (5, "one"), (6, "ONE"), (7, "one two three"), (8, "Ünï two three"), (9, "ünï two three")]
    at = 10
    for size in (60, 120, 400):
        base = [word() for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 3, 4, 6, 9, 14] * 3:
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append((at, " ".join(copy)))
            at += 1
    chain = [word() for _ in range(80)]
    for step in range(60):  # neighbours link, the ends do not
        chain = chain[1:] + [word()] if step % 2 else chain
        rows.append((at, " ".join(chain)))
        at += 1
    rows.append((at, " ".join(word() for _ in range(30_000))))
    return rows


def check(spark, rows, n, threshold):
    extra = [(i, t, "x", "clash", None) for i, t in rows]
    random.Random(1).shuffle(extra)
    out = minhash.near_dedup(spark.createDataFrame(extra, SCHEMA), ngram=n, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute(rows, n, threshold.numerator, threshold.denominator)
    assert len(out) == len(rows)


def test_matches_all_pairs(spark):
    check(spark, fixture_rows(), 3, Fraction(85, 100))
    check(spark, fixture_rows(), 5, Fraction(4, 5))


def test_blocks_of_large_groups(spark, monkeypatch):
    """With small blocks, groups span many of them and every way of comparing is used."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    check(spark, fixture_rows(), 3, Fraction(85, 100))


def boilerplate_rows(n=90):
    """Different texts that share much of their words, so that many collide in a band and few are alike."""
    rng = random.Random(9)
    shared = [f"licence{i}" for i in range(150)]
    rows = []
    for i in range(n):
        own = [f"own{i}x{j}" for j in range(rng.randrange(40, 60))]
        rows.append((i, " ".join(shared + own)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join(shared + own[:-2] + ["tail"])))
    return rows


def test_wide_groups_of_different_texts(spark, monkeypatch):
    """One cluster of colliding buckets, hardly any links: buckets, then rare shingles, take its place."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "NARROW", 6)
    seen = []
    inner = minhash._by_rare_shingles
    monkeypatch.setattr(minhash, "_by_rare_shingles", lambda *a: seen.append(1) or inner(*a))
    check(spark, boilerplate_rows(), 3, Fraction(85, 100))
    assert seen


def test_salted_and_shuffled_joins(spark, monkeypatch):
    """No table may be broadcast: hot hubs, buckets and groups are salted."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "NARROW", 6)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
    check(spark, boilerplate_rows(40) + [(2000 + i, "the very same words again and " + "again " * (i % 3)) for i in range(40)], 3, Fraction(85, 100))


def test_nulls_repeats_and_empty(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, None), (5, text), (5, text), (7, text), (None, text)]
    out = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), ngram=3).collect()
    assert len(out) == 6
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id) == [(5, 5, True), (5, 5, True), (7, 5, False)]
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_rarely_miss():
    for t in (Fraction(4, 5), Fraction(85, 100), Fraction(1, 2), Fraction(1)):
        bands, r = minhash.plan_bands(256, t)
        assert (1 - float(t) ** r) ** bands <= minhash.MISS and bands * r <= 256


def test_query_on_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = queries.op1_minhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute([(r.doc_id, r.text) for r in docs], 3, 85, 100)
