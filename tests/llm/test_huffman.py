import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import huffman, queries

tokenizers = pytest.importorskip("tokenizers")


def plain(path, texts):
    tok = tokenizers.Tokenizer.from_file(path)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=200))
def test_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    free = huffman.code_lengths(counts, 40)
    assert int((free * counts).sum()) == huffman_cost(counts.tolist())
    tight = huffman.code_lengths(counts, 8)
    assert tight.max() <= 8 and (2.0 ** -tight).sum() <= 1 and int((tight * counts).sum()) >= huffman_cost(counts.tolist())
    codes = huffman.canonical(tight)
    words = {format(c, f"0{n}b") for c, n in zip(codes.tolist(), tight.tolist(), strict=True)}
    assert len(words) == len(counts) and not any(a != b and b.startswith(a) for a in words for b in words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=3000))
def test_round_trip(ids):
    ids = np.array(ids, np.uint32)
    names, counts = np.unique(ids, return_counts=True)
    codec = huffman.Codec(names.astype(np.int64), huffman.code_lengths(counts))
    bits, marks = codec.encode(ids)
    assert np.array_equal(codec.decode(bits, len(ids), marks), ids)


TEXTS = ["Hello, World. it's we're 3rd 1.5 a.,b .x", "", None, "  \t\n", "<|endoftext|> <|ENDOFTEXT|>x <|", "ΑΣ. ΟΔΟΣ, straße. İstanbul KELVIN K", "é. Å, ́ á.", "\x1c\x1f a\x85b c d", "word..word,,word.,", "naïve,naïve. 日本語。テスト.", "¿qué? «oui». 100%.,", "a" * 5000 + " b"]


def test_chunks_encode_as_whole_texts():
    path = queries.word_tokenizer()
    rng = random.Random(2)
    pieces = ["It's", "we'll", "thing.", "thing,", "A.B.", "é.", "ß", "Σ", "İ", "́", "12.", "12", "x1,", "..", "'", "’s", "***", "$", "\n", "\t", " ", " ", "\x1c", "<|", "|>", "<|endoftext|>", "_", "-", "日本"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(30)) for _ in range(400)]
    encoder = huffman.ChunkEncoder(path)
    assert encoder.by_chunk
    for text, ids, got in zip(texts, plain(path, texts), encoder.ids(texts), strict=True):
        assert np.frombuffer(got, encoder.kind).tolist() == ids[:-1], text


@pytest.mark.parametrize("block", [huffman.BLOCK_IDS, 7])
def test_files_round_trip(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(huffman, "BLOCK_IDS", block)
    rows = [(i * 3 - 9, t, "clash", 1) for i, t in enumerate(TEXTS)]
    random.Random(1).shuffle(rows)
    path, tok = f"file://{tmp_path}/ids", queries.word_tokenizer()
    huffman.write_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int"), path, tok)
    out = {r.doc_id: r for r in huffman.read_ids(spark, path, with_ids=True).collect()}
    start = 0
    for doc, text in sorted((r[0], r[1]) for r in rows):
        ids = plain(tok, [text])[0]
        assert (out[doc].start, out[doc].n_tokens, out[doc].ids) == (start, len(ids), ids)
        assert out[doc].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(out) == len(rows)


def test_nulls_repeats_and_empty(spark, tmp_path):
    tok = queries.word_tokenizer()
    huffman.write_ids(spark.createDataFrame([(None, "x"), (4, "y y"), (4, "y y"), (3, None)], "doc_id long, text string"), f"file://{tmp_path}/a", tok)
    out = sorted((r.start, r.doc_id, r.n_tokens) for r in huffman.read_ids(spark, f"file://{tmp_path}/a").collect())
    assert out == [(0, None, 2), (2, 3, 1), (3, 4, 3), (6, 4, 3)]
    huffman.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/b", tok)
    assert huffman.read_ids(spark, f"file://{tmp_path}/b").count() == 0


def test_query_on_its_table(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for (doc, _), ids in zip(docs, plain(queries.word_tokenizer(), [t for _, t in docs]), strict=True):
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op7_huffman(spark, sf_dir).collect()) == want


def test_rows_without_an_id_are_spread(spark, tmp_path):
    texts = [f"{i} words of a text {i * 7919 % 1000}" for i in range(400)]
    path = str(tmp_path / "none")
    huffman.write_ids(spark.createDataFrame([(None, t) for t in texts] + [(1, "x")], "doc_id long, text string"), path, queries.word_tokenizer())
    out = huffman.read_ids(spark, path, with_ids=True).collect()
    assert sorted(tuple(r.ids) for r in out) == sorted(tuple(x) for x in plain(queries.word_tokenizer(), [*texts, "x"]))
    rows = sorted(out, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))] and rows[-1].doc_id == 1
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/blocks").selectExpr("shard", "size(doc_ids) as n").groupBy("shard").sum("n").withColumnRenamed("sum(n)", "count").collect()]
    assert len(sizes) > 3 and max(sizes) < 200
