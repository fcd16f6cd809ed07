import random

import numpy as np
import pytest
import xxhash

from quarryline.llm import queries, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()  # texts of the tests have ASCII blanks only
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in found]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over at most two bits, for ``{id: [fingerprint, ...]}``."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any((a ^ b).bit_count() <= 2 for a in prints[i] for b in prints[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def classes(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)), n) for n, v in enumerate(values)], "bits long, node long")


def linked(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_equal_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    values = {0, 2**64 - 1, 1 << 63}
    for _ in range(60):  # chains of one or two changed bits, so that components have many members
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(at)
            for _ in range(rng.randint(1, 3)):
                at ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    values |= {centre ^ 1 << i ^ 1 << j for i in range(0, 64, 3) for j in range(0, 64, 5)}  # a crowd
    values = sorted(values)
    found = simhash.near_links(classes(spark, values), crowd=crowd).collect()
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in found)
    want = plain_components({n: [v] for n, v in enumerate(values)})
    assert linked(found, len(values)) == [want[n] for n in range(len(values))]


def test_fingerprints(spark):
    texts = [None, "", " \n\t", "One", "one TWO", "A b c", "a b c d a b c d", "Ünïcode ÄÖ straße x y", "w " * 30_000, " ".join(map(str, range(300)))]
    rows = [(n, t) for n, t in enumerate(texts)]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: f"{plain_fingerprint(t):016x}" for n, t in rows}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "the same text here", 1), (3, "The SAME text here", 1), (None, "the same text here", 1), (9, "x y z", 1), (9, "the same text here", 1), (7, "x y z", 1), (4, None, 1), (8, " ", 1), (9, "x y z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `bits` int").withColumnRenamed("bits", "a.b")
    got = sorted((tuple(r) for r in simhash.near_dedup(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, None), (9, 3), (9, 3), (9, 3), (7, 3), (4, 4), (8, 4)], key=str)
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_hot_classes_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = [(n, "one common text") for n in range(10, 40)] + [(n, f"rare words {n}") for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (100_000, 0):  # broadcast, salted
        monkeypatch.setattr(simhash, "BROADCAST_CLASSES", most)
        got = dict(map(tuple, simhash.near_dedup(docs).select("doc_id", "component_id").collect()))
        assert {got[n] for n in range(10, 40)} == {10} and len(got) == 35


def test_query_equals_brute_force(spark, sf_dir):
    got = queries.op12_simhash(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs if len(r["text"] or "") < 20_000}
    have = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len(got) == len(docs) and all(have[d] == f"{p:016x}" for d, p in prints.items())
    want = plain_components({d: [int(p, 16)] for d, p in have.items()})
    assert {r["doc_id"]: r["component_id"] for r in got} == want
