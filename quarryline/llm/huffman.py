"""Token ids as canonical, length-limited Huffman code in independent blocks.

Layout under one path, on any store that Spark writes:

``codebook``  id, length. Codes are canonical: by length, then id.
``blocks``    a row for each block of whole documents: shard, block, first (ids
              of the shard before it), n_ids, doc_ids, doc_tokens, bits (first bit highest), checkpoints (bit
              offset of every ``EVERY``-th id).
``index``     a row for each shard: n_docs, n_ids, start (ids of all shards
              before it). Written last; a path without it is incomplete.

Shards are ranges of doc_id in ascending order, blocks ascend within a shard
and documents within a block, nulls first, so the concatenation of all blocks
is the corpus in doc_id order. A block decodes by itself; its checkpoints let
the decoder walk all its stretches in step, one table look-up an id.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import ASCII_LOWER, process_cache, slices
from quarryline.session import materialize

EVERY = 128
BLOCK_IDS = 1 << 17
MAX_BITS = 16
CACHE_WORDS, KEPT_WORDS = 650_000, 300_000
_PUNCTUATION = string.punctuation.replace("'", "")


class ChunkEncoder:
    """The tokenizer's ids of a text, a blank-free chunk at a time, with the chunks' ids remembered.

    Exact for tokenizers whose splits never span white space and which fold
    case, as a check of the tokenizer's settings makes sure; any other one
    encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_chunk = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in splits[0]["pattern"].get("Regex", "") and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        self.kind = id_type(self.tokenizer.get_vocab_size())
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.places, self.values = Places(), []  # chunks in order, and the ids of each

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of chunks of letters alone, a piece each, encoded many at a time and cut after the ids that end a piece."""
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            some = texts[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                out += self._raw(some)
                continue
            raw, size = ids.tobytes(), ids.itemsize
            out += [raw[a * size : b * size] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        return out

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each new chunk. Letters before a run of ASCII punctuation without apostrophes are pieces apart from it."""
        split, stems, tails, whole = [], {}, {}, {}
        for chunk in chunks:
            word = chunk.decode("utf-8", "surrogatepass")
            stem = word if word.isalpha() else word.rstrip(_PUNCTUATION)
            if stem.isalpha() and stem.lower().isalpha():  # a letter may become one with a mark, which joins what follows
                split.append((stem, word[len(stem) :]))
                stems[stem] = tails[word[len(stem) :]] = None
            else:
                split.append((word, None))
                whole[word] = None
        done = len(self.values)
        at = {w: self.places.get(w.encode(), done) for w in stems}
        ids = {w: self.values[i] for w, i in at.items() if i < done}
        new = [w for w in stems if w not in ids]
        ids.update(zip(new, self._pieces(new), strict=True))
        ends = dict(zip(tails, self._raw(list(tails)), strict=True))
        ends[None] = b""
        rest = dict(zip(whole, self._raw(list(whole)), strict=True))
        return [rest[w] if t is None else ids[w] + ends[t] for w, t in split]

    def trim(self, most: int, kept: int) -> None:
        """Beyond ``most`` remembered chunks, keep the first: common ones appear early."""
        if len(self.places) > most:
            self.places, self.values = Places(islice(self.places.items(), kept)), self.values[:kept]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``kind``."""
        self.trim(CACHE_WORDS, KEPT_WORDS)
        place, codes = self.places.__getitem__, []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            if self.by_chunk and b"<|" not in raw and not any(m in raw for m in self.marks):
                codes.append(list(map(place, raw.translate(ASCII_LOWER).split())))
            else:
                codes.append(None)
        self.values += self._learn(self.places.fresh)
        self.places.fresh = []
        value = self.values.__getitem__
        return [self._raw([t])[0] if c is None else b"".join(map(value, c)) for t, c in zip(texts, codes, strict=True)]


class Places(dict):
    """A number for each chunk, in order of appearance."""

    def __init__(self, items=()) -> None:
        super().__init__(items)
        self.fresh: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        at = self[chunk] = len(self)
        self.fresh.append(chunk)
        return at


def id_type(vocabulary: int) -> str:
    """Two bytes an id where they suffice."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _tokenize(path: str, end_id: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_cache(f"chunks:{path}", lambda: ChunkEncoder(path))
        end = np.array([end_id], encoder.kind).tobytes()
        for part in slices(batches):
            ids = [x + end for x in encoder.ids([t or "" for t in part.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        encoder.trim(kept, kept)

    return run


def _joined(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """All ids of a column of byte strings without nulls, end to end, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if len(column) else np.empty(0, kind)


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in slices(batches, 65536):
            seen = np.bincount(_joined(part.column(0), kind))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; every count is positive.

    A single symbol gets one bit.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels = []  # for each level, whether each item of the sorted list is a leaf
    weights = leaf
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(weights) // 2 * 2
        packs = weights[:even:2] + weights[1:even:2]
        both = np.concatenate([leaf, packs])
        place = np.argsort(both, kind="stable")
        weights, is_leaf = both[place], place < n
    levels.append(is_leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * (n - 1)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then position; a shorter code is never the start of a longer one."""
    codes = np.zeros(len(lengths), np.int64)
    code = last = 0
    for at in np.lexsort((np.arange(len(lengths)), lengths)):
        code <<= int(lengths[at]) - last
        last = int(lengths[at])
        codes[at] = code
        code += 1
    return codes


class Codec:
    """Encoder and table-driven decoder of one codebook."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.codes = canonical(self.lengths)
        self.width = int(self.lengths.max(initial=1))
        size = 1 << self.width
        self.table_id, self.table_len = np.zeros(size, np.uint32), np.ones(size, np.int64)
        for i, n, c in zip(self.ids.tolist(), self.lengths.tolist(), self.codes.tolist(), strict=True):
            lo = c << (self.width - n)
            self.table_id[lo : lo + (1 << (self.width - n))] = i
            self.table_len[lo : lo + (1 << (self.width - n))] = n
        self.at = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        self.at[self.ids] = np.arange(len(self.ids))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, and the bit offset of every ``EVERY``-th id."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        at = self.at[ids]
        length = self.lengths[at]
        ends = np.cumsum(length)
        start = ends - length
        word, shift = start >> 5, 64 - (start & 31) - length
        value = self.codes[at].astype(np.uint64) << shift.astype(np.uint64)  # a code of up to 33 bits lies in two words
        words = int(ends[-1] >> 5) + 2
        high = np.bincount(word, weights=value >> np.uint64(32), minlength=words)  # sums of distinct bits, exact in doubles
        high[1:] += np.bincount(word, weights=value & np.uint64(0xFFFFFFFF), minlength=words)[:-1]
        return high.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], start[::EVERY]

    def decode(self, bits: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        peek = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        pos = np.array(checkpoints, np.int64)
        out = np.empty((len(pos), EVERY), np.uint32)
        last = len(bits) * 8
        drop, keep = 32 - self.width, (1 << self.width) - 1
        for t in range(EVERY):
            seen = (peek[pos >> 3] >> (drop - (pos & 7)).astype(np.uint32)) & np.uint32(keep)
            out[:, t] = self.table_id[seen]
            pos = np.minimum(pos + self.table_len[seen], last)
        return out.ravel()[:n]


BLOCKS = "shard int, block int, first long, n_ids long, doc_ids array<long>, doc_tokens array<int>, bits binary, checkpoints array<int>"


def _encode(book, kind: str):
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*book.value)
        held: list[tuple] = []
        size = block = first = 0

        def pack(shard: int):
            bits, marks = codec.encode(np.frombuffer(b"".join(x[1] for x in held), kind))
            columns = [[shard], [block], [first], [size], [[x[0] for x in held]], [[len(x[1]) // width for x in held]], [bits], [marks.tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        shard = -1
        for part in slices(batches):
            for shard, doc, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held.append((doc, ids))
                size += len(ids) // width
                if size >= BLOCK_IDS:
                    yield pack(shard)
                    held, size, block, first = [], 0, block + 1, first + size
        if held:
            yield pack(shard)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = MAX_BITS, kept_words: int = CACHE_WORDS) -> None:
    """Encode ``docs(doc_id, text)`` under ``path``, each text's ids followed by ``end_id``.

    Null text is empty: only the end id. Null doc_ids come first, repeated rows
    are all written, equal doc_ids in the order of their ids' bytes. An empty
    table gives an empty codebook and no blocks. A worker remembers at most
    ``kept_words`` chunks from one task to the next.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    kind = ChunkEncoder(tokenizer).kind
    if end_id >= 1 << 8 * np.dtype(kind).itemsize:
        raise ValueError(f"end id {end_id} does not fit the vocabulary's type")
    tokens = materialize(docs.mapInArrow(_tokenize(tokenizer, end_id, kept_words), "doc_id long, ids binary"), "tokens")
    counted = tokens.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()  # a row for each id of the vocabulary
    ids, counts = (np.asarray(counted.column(c)) for c in ("id", "n"))
    lengths = code_lengths(counts, max(limit, int(max(len(ids), 2) - 1).bit_length()))
    spark.createDataFrame(zip(ids.tolist(), lengths.tolist(), strict=True), "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, or of none, are dealt by how their ids begin, which keeps to the order
    dealt = tokens.repartitionByRange(shards, "doc_id", F.substring("ids", 1, 16)).sortWithinPartitions("doc_id", "ids")
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "ids")
    dealt.mapInArrow(_encode(book, kind), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n_docs"), F.sum("n_ids").alias("n_ids")).orderBy("shard").collect()  # a row for each shard
    index, start = [], 0
    for row in totals:
        index.append((row.shard, row.n_docs, row.n_ids, start))
        start += row.n_ids
    spark.createDataFrame(index, "shard int, n_docs long, n_ids long, start long").coalesce(1).write.parquet(f"{path}/index")


def _decode(book, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*book.value)
        for batch in batches:
            for i in range(batch.num_rows):
                n, docs, sizes, bits, marks, start = (c[i].as_py() for c in batch.columns)
                ids = codec.decode(bits, n, np.array(marks, np.int64))
                ends = np.cumsum(sizes)
                firsts = ends - sizes
                parts = [ids[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(firsts + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document under ``path``, and its ``ids`` if wanted."""
    rows = spark.read.parquet(f"{path}/codebook").toArrow()
    book = spark.sparkContext.broadcast((np.asarray(rows.column("id")), np.asarray(rows.column("length")).astype(np.int64)))
    index = spark.read.parquet(f"{path}/index").select("shard", "start")  # a row for each shard
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(index), "shard").withColumn("start", F.col("start") + F.col("first"))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return blocks.select("n_ids", "doc_ids", "doc_tokens", "bits", "checkpoints", "start").mapInArrow(_decode(book, with_ids), out)
