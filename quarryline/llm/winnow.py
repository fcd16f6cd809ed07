"""Benchmark decontamination by winnowing.

Both sides are fingerprinted: of the hashes of ``k`` consecutive words, the
smallest of each ``w`` neighbours is kept. Any ``w + k - 1`` words that two
texts share hold a common fingerprint; with ``w = window - k + 1`` that is
every shared window. A common fingerprint is extended word by word to the
longest shared run around it; runs of at least ``window`` words are hits.

Items of fewer words than ``window`` are one window each. Winnowing guarantees
nothing for so short a span, so these are looked up exactly, by the hash of all
their words at every document position.

A benchmark of at most ``BROADCAST_WORDS`` words and ``BROADCAST_BYTES`` is
broadcast, and the documents are only scanned. A larger one stays in the
cluster: fingerprints of both sides are joined by their hashes, the documents'
after a bit mask of the benchmark's (``MASK_BITS``, whatever its size), and each
pair of document and item so found is extended. The items' side of both joins is
copied ``SALTS`` times, so that no frequent fingerprint or item gathers in a
task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import WordHashes, grams, map_rows, share, slices
from quarryline.session import materialize

BROADCAST_WORDS = 2_000_000
BROADCAST_BYTES = 64 << 20
MASK_BITS = 26
SALTS = 16
#: Bytes that separate words, as blanks; A-Z in lower case; other bytes as they are.
_TABLE = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of each ``w`` neighbours (the rightmost of equals); all of fewer."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    low, at = hashes[: n - w + 1].copy(), np.arange(n - w + 1)
    for j in range(1, w):
        other = hashes[j : n - w + 1 + j]
        take = other <= low
        low[take] = other[take]
        at[take] = np.flatnonzero(take) + j
    return np.unique(at)


class Block:
    """Items with their words and fingerprints, sorted for lookup."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int, k: int) -> None:
        self.window, self.k, self.w = window, k, window - k + 1
        hashes = WordHashes(10**9)
        self.names = [i for i, _ in items]
        self.words = [hashes.of(ws) for _, ws in items]
        keys, owner, place = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for j, ws in enumerate(self.words):
            if len(ws) >= window:
                gram = grams(ws, k)
                at = winnow(gram, self.w)
                keys.append(gram[at])
                owner.append(np.full(len(at), j))
                place.append(at)
            elif len(ws):
                self.short.setdefault(len(ws), {}).setdefault(int(grams(ws, len(ws))[0]), []).append(j)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        order = np.argsort(all_keys := join(keys, np.uint64), kind="stable")
        self.keys, self.owner, self.place = all_keys[order], join(owner, np.int64)[order], join(place, np.int64)[order]
        size = 1 << min(22, (1024 * len(self.keys)).bit_length())
        self.low = np.uint64(size - 1)
        self.mask = np.zeros(size, bool)  # most document fingerprints end here
        self.mask[(self.keys & self.low).astype(np.int64)] = True

    def candidates(self, gram: np.ndarray) -> np.ndarray:
        return self.mask[(gram & self.low).astype(np.int64)]

    def hits(self, words: np.ndarray, gram: np.ndarray, at: np.ndarray, hit: np.ndarray) -> set[int]:
        """Marks hit words in ``hit`` and returns the items with windows there."""
        found: set[int] = set()
        done: dict[tuple[int, int], int] = {}  # (item, diagonal): end of the last run extended
        for p in at[self.candidates(gram[at])].tolist():
            lo, hi = np.searchsorted(self.keys, gram[p], "left"), np.searchsorted(self.keys, gram[p], "right")
            for j, q in zip(self.owner[lo:hi].tolist(), self.place[lo:hi].tolist(), strict=True):
                if done.get((j, p - q), -1) > p:
                    continue
                start, end = self._extend(words, self.words[j], p, q)
                done[j, p - q] = end
                if end - start >= self.window:
                    hit[start:end] = True
                    found.add(j)
        for n, table in self.short.items():
            gram = grams(words, n)
            for p in np.flatnonzero(np.isin(gram, np.fromiter(table, np.uint64, len(table)))).tolist():
                for j in table[int(gram[p])]:
                    if np.array_equal(words[p : p + n], self.words[j]):
                        hit[p : p + n] = True
                        found.add(j)
        return found

    @staticmethod
    def _extend(a: np.ndarray, b: np.ndarray, p: int, q: int) -> tuple[int, int]:
        """The shared run through ``a[p] == b[q]``; start and end in ``a``; empty if they differ."""
        n = min(len(a) - p, len(b) - q)
        differ = np.flatnonzero(a[p : p + n] != b[q : q + n])
        ahead = int(differ[0]) if len(differ) else n
        back = min(p, q)
        differ = np.flatnonzero(a[p - back : p][::-1] != b[q - back : q][::-1])
        behind = int(differ[0]) if len(differ) else back
        return p - behind, p + ahead


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64())), ("contaminated", pa.bool_())])


def _match(texts: list[str | None], block: Block, hashes: WordHashes) -> tuple[list[np.ndarray], list[set[int]]]:
    """Hit words and found items of each text."""
    hits, found = [], []
    for text in texts:
        words = hashes.of(words_of(text))
        gram = grams(words, block.k)
        hit = np.zeros(len(words), bool)
        found.append({block.names[j] for j in block.hits(words, gram, winnow(gram, block.w), hit)})
        hits.append(hit)
    return hits, found


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), shared()
        for part in slices(batches):
            hit, found = _match(part.column(1).to_pylist(), block, hashes)
            n = [int(h.sum()) for h in hit]
            columns = [part.column(0), pa.array([len(h) for h in hit], pa.int64()), pa.array(n, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array([x > 0 for x in n])]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)

    return run


def _clean(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), shared()
        for part in slices(batches):
            hit, _ = _match(part.column(text_at).to_pylist(), block, hashes)
            yield part.filter(pa.array([not h.any() for h in hit], pa.bool_()))

    return run


def _small_benchmark(benchmark: DataFrame, window: int, k: int):
    """The broadcast block of a benchmark of a proven size, else None."""
    words = F.regexp_count("text", F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+"))
    size = benchmark.agg(F.sum(words).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if (size.words or 0) > BROADCAST_WORDS or (size.bytes or 0) > BROADCAST_BYTES:
        return None
    items = [(r.item_id, words_of(r.text)) for r in benchmark.collect()]
    return share(benchmark.sparkSession, Block([x for x in items if x[1]], window, k))


def _prints(window: int, k: int, short: list[int] | None, mask):
    """``at, n, key`` of each text's fingerprints (n = 0) and of its runs of n words, for the lengths in ``short``.

    ``short`` None: an item, which has its fingerprints or, where it is shorter
    than the window, its one run. Only keys in ``mask`` count, if there is one.
    """

    def keys(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if short is None and 0 < len(words) < window:
            yield len(words), grams(words, len(words))
            return
        gram = grams(words, k)
        yield 0, gram[winnow(gram, window - k + 1)]
        for n in short or ():
            yield n, grams(words, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            for at, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for n, found in keys(hashes.of(words_of(text))):
                    found = np.unique(found)
                    if mask is not None:
                        low = found & np.uint64((1 << MASK_BITS) - 1)
                        bit = mask.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)).astype(np.int64)
                        found = found[(bit & 1).astype(bool)]
                    if len(found):
                        m = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, at, np.int64)), pa.array(np.full(m, n, np.int32)), pa.array(found.view(np.int64))], ["at", "n", "key"])

    return run


def _runs(window: int, k: int):
    """Pairs of a text and an item's: the runs of hit words."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            out = []
            for text, item in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                (hit,), _ = _match([text], Block([(0, words_of(item))], window, k), hashes)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                out.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], ["at", "item_id", "runs"])

    return run


def _joined_hits(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``at, items, n_hit`` of the rows of ``docs(at, text)``, a written table, that are hit; by joins of fingerprints."""
    spark = docs.sparkSession
    items = materialize(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    kinds = "at long, n int, key long"
    theirs = materialize(items.select("item", "text").mapInArrow(_prints(window, k, None, None), kinds), "item-prints")
    lengths = sorted(r.n for r in theirs.where("n > 0").select("n").distinct().collect())  # below the window
    low = F.col("key").bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    bits = theirs.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).collect()  # at most 2**(MASK_BITS - 6) rows
    mask = np.zeros(1 << (MASK_BITS - 6), np.int64)
    mask[[r.word for r in bits]] = [r.bits for r in bits]
    ours = docs.select("at", "text").mapInArrow(_prints(window, k, lengths, spark.sparkContext.broadcast(mask)), kinds)

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("salt")
    pairs = ours.select("*", salt).join(theirs.select(F.col("at").alias("item"), "n", "key", salts), ["n", "key", "salt"])
    pairs = materialize(pairs.select("at", "item").distinct(), "pairs")
    whole = pairs.select("*", salt).join(items.select("item", "item_id", F.col("text").alias("theirs"), salts), ["item", "salt"]).join(docs.select("at", "text"), "at")
    runs = whole.select("at", "item_id", "text", "theirs").mapInArrow(_runs(window, k), "at long, item_id long, runs array<struct<start:long,end:long>>").where("size(runs) > 0")
    both = runs.groupBy("at").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    covered = F.expr("aggregate(runs, struct(0L as reach, 0L as n), (a, r) -> struct(greatest(a.reach, r.end) as reach, a.n + greatest(0L, r.end - greatest(a.reach, r.start)) as n), a -> a.n)")
    return both.select("at", "items", covered.alias("n_hit"))


def _items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("item_id is not null and text is not null")


def _check(window: int, k: int) -> None:
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; with a benchmark that can be broadcast a narrow operation.

    Null ids, null texts and repeated rows are judged by their text alone. Other
    columns of any name pass through. Empty tables: no rows, or all of them.
    """
    _check(window, k)
    items = _items_of(benchmark)
    if block := _small_benchmark(items, window, k):
        return map_rows(docs, _clean(block, docs.columns.index("text")))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row"), docs["text"].alias("text")), "rows")
    return rows.join(_joined_hits(rows, items, window, k), "at", "left_anti").select("row.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for each row of ``docs(doc_id, text)``.

    ``benchmark(item_id, text)``. A document word inside any occurrence of an
    item's window is hit. Null or empty text: no words, not contaminated. Items
    without words or with a null id match nothing; repeated items count once.
    Repeated rows are each returned. Nothing depends on an order, so there are no
    ties. Empty tables: no rows, or no hits.
    """
    _check(window, k)
    items = _items_of(benchmark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n_words long, n_hit long, n_items long, items array<long>, contaminated boolean"
    if block := _small_benchmark(items, window, k):
        return docs.mapInArrow(_scan(block), kinds)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text"), "rows")
    found = _joined_hits(rows, items, window, k)
    none = share(docs.sparkSession, Block([], window, k))
    counted = rows.select("at", "text").mapInArrow(_scan(none), kinds).select(F.col("doc_id").alias("at"), "n_words")
    n, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<long>"))
    return rows.select("at", "doc_id").join(counted, "at").join(found, "at", "left").select("doc_id", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n > 0).alias("contaminated"))


def with_digest(found: DataFrame) -> DataFrame:
    """``items_sha256`` (ids sorted as strings, comma-joined) in place of ``items``."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumn("items_sha256", F.sha2(names, 256)).drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL of the query's columns: every window of every length that an item has, looked up whole.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM n),
z AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, z WHERE len(w) >= n),
m AS (SELECT doc_id, p, p.n, item_id FROM p JOIN g ON p.n = g.n AND array_to_string(w[p:p + p.n - 1], ' ') = g.g),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
