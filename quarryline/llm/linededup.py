"""Repeated lines across documents, found with two Bloom filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at either end, ASCII
letters in lower case. Keys of ``min_chars`` code points that at least two
documents hold lose all their lines except in the smallest doc_id that holds
them.

1. Each task hashes the keys of its rows, once a document, and reports the cells
   set by one document and those set by a further one, as the gaps between them,
   a byte or two each. The reports are merged cell range by cell range, in as
   many tasks as there are ranges, into the filter of cells that at least two
   documents have set. (Once-seen OR once-seen is once-seen; where
   both had it, it is twice-seen.)
2. Only keys whose cells are all twice-seen are suspects and are shuffled, as
   128-bit hashes, for exact confirmation and the choice of the first document.
3. Lines are dropped with the confirmed keys: as a broadcast table while that
   is under ``BROADCAST_BYTES``, else by a join on doc_id of the documents that
   have suspects. In that join keys of more than ``HOT`` rows, which there can
   be only one of for ``HOT`` suspects, are broadcast, and the rest shuffled.

The filter has at most ``MAX_CELLS`` cells whatever the input; beyond the size
that suits this, more keys are suspects and step 2 moves more, with the same
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ASCII_LOWER, slices
from quarryline.session import materialize

STRIP = b" \t\n\x0b\x0c\r"
PROBES = 3
SEGMENT = 1 << 20  # cells merged at a time
MAX_CELLS = 1 << 30  # 128 MB as bits
CELLS_PER_LINE = 16
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 24
HOT = 10_000


def line_key(line: str, min_chars: int) -> bytes | None:
    """The key, or None for a line too short to count."""
    key = line.encode("utf-8", "surrogatepass").strip(STRIP)
    if len(key) < min_chars:
        return None
    key = key.translate(ASCII_LOWER)
    return key if key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars else None


def key_hashes(text: str | None, min_chars: int) -> list[int | None]:
    """128-bit hash of each line's key; None where the line cannot count."""
    return [None if k is None else xxhash.xxh3_128_intdigest(k) for k in (line_key(x, min_chars) for x in (text or "").split("\n"))]


def cells_of(low: np.ndarray, high: np.ndarray, cells: int) -> np.ndarray:
    """``PROBES`` cells of each hash, by double hashing; ``cells`` is a power of two."""
    step = high | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(PROBES)])


def _split(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def packed(cells: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them, in bytes; 255 stands for a gap of 255 that goes on."""
    more, last = np.divmod(np.diff(cells, prepend=0), 255)
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = last
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _report(min_chars: int, cells: int):
    """Cells that the rows of a task set: by one document, and by more."""

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, seen = np.unique(np.concatenate(parts), return_counts=True)
        bounds = np.flatnonzero(np.diff(cell // np.uint64(SEGMENT))) + 1
        segments, once, twice = [], [], []
        for at, many in zip(np.split(cell, bounds), np.split(seen, bounds), strict=True):
            segments.append(int(at[0]) // SEGMENT)
            inner = (at % np.uint64(SEGMENT)).astype(np.int64)
            once.append(packed(inner))
            twice.append(packed(inner[many > 1]))
        yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = {h for h in key_hashes(text, min_chars) if h is not None}
                if doc is None or not found:
                    continue
                parts.append(np.unique(cells_of(*_split(list(found)), cells)))
                held += len(parts[-1])
            if held > 4_000_000:
                yield from emit(parts)
                parts, held = [], 0
        if parts:
            yield from emit(parts)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment: the twice-seen bits of each, with one segment in memory at a time."""
    now, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    for batch in batches:
        for segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != now:
                if now is not None:
                    yield done()
                now, once, twice = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            a, b = unpacked(a), unpacked(b)
            twice[a[once[a]]] = True
            twice[b] = True
            once[a] = True
    if now is not None:
        yield done()


def twice_seen(docs: DataFrame, min_chars: int, cells: int) -> np.ndarray:
    """Bits of the cells that at least two documents set; of ``cells / 8`` bytes, bounded by ``MAX_CELLS``."""
    reports = docs.mapInArrow(_report(min_chars, cells), "segment long, once binary, twice binary")
    parts = max(1, cells // SEGMENT)  # at most MAX_CELLS / SEGMENT
    merged = reports.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment long, bits binary")
    bits = np.zeros(max(cells, SEGMENT) // 8, np.uint8)
    for part in merged.toArrow().to_batches():  # one job; as many bytes as the filter has
        for segment, found in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            at = segment * SEGMENT // 8
            bits[at : at + SEGMENT // 8] = np.frombuffer(found.as_buffer(), np.uint8)
    return bits


def _suspected(low: np.ndarray, high: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    at = cells_of(low, high, cells)
    return ((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def _suspects(min_chars: int, cells: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in slices(batches):
            docs, hashes = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = sorted({h for h in key_hashes(text, min_chars) if h is not None}) if doc is not None else ()
                docs += [doc] * len(found)
                hashes += found
            if not hashes:
                continue
            low, high = _split(hashes)
            hit = _suspected(low, high, bits, cells)
            yield pa.RecordBatch.from_arrays([pa.array(low[hit].view(np.int64)), pa.array(high[hit].view(np.int64)), pa.array(np.array(docs, np.int64)[hit])], ["low", "high", "doc_id"])

    return run


OUT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _cut(doc: int | None, text: str | None, hashes: list[int | None], gone) -> tuple:
    lines = (text or "").split("\n")
    kept = "\n".join(x for x, h in zip(lines, hashes, strict=True) if h is None or not gone(h))
    dropped = sum(1 for h in hashes if h is not None and gone(h))
    return doc, len(lines), dropped, kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in OUT.split(", ")])


def _drop_broadcast(min_chars: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, first = shared.value  # sorted by low, then high

        def owner(h: int) -> int | None:
            a, b = h & (2**64 - 1), h >> 64
            at = int(np.searchsorted(low, np.uint64(a)))
            while at < len(low) and low[at] == a:
                if high[at] == b:
                    return int(first[at])
                at += 1
            return None

        for part in slices(batches):
            rows, hashed = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hashed.append((doc, text, key_hashes(text, min_chars)))
            every = sorted({h for _, _, hs in hashed for h in hs if h is not None})
            near = set()
            if every and len(low):
                lows, _ = _split(every)
                at = np.minimum(np.searchsorted(low, lows), len(low) - 1)
                near = {h for h, hit in zip(every, low[at] == lows, strict=True) if hit}
            owners = {h: o for h in near if (o := owner(h)) is not None}
            for doc, text, hs in hashed:
                rows.append(_cut(doc, text, hs, lambda h, doc=doc: doc is not None and owners.get(h, doc) != doc))
            yield _rows(rows)

    return run


def _drop_joined(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, text, gone in zip(*(c.to_pylist() for c in part.columns), strict=True):
                names = {((x["high"] & (2**64 - 1)) << 64) | (x["low"] & (2**64 - 1)) for x in gone or ()}
                rows.append(_cut(doc, text, key_hashes(text, min_chars), names.__contains__))
            yield _rows(rows)

    return run


def _few(keys: DataFrame) -> DataFrame:
    """A broadcast hint while the counted keys take at most ``BROADCAST_BYTES``; beyond that, of 26 thousand million suspects, Spark joins."""
    return F.broadcast(keys) if keys.count() * KEY_BYTES <= BROADCAST_BYTES else keys


def line_dedup(docs: DataFrame, min_chars: int = 10, max_cells: int = MAX_CELLS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text, kept_sha256`` for each row of ``docs(doc_id, text)``.

    Null or empty text: one empty line, nothing dropped. Null doc_id: the row's
    lines count for nobody and all stay. Repeated rows: rows of one doc_id are
    one document, so its lines do not repeat across them; each row is returned.
    Ties: the smallest doc_id that holds the key keeps all its lines of that
    key. Empty table: no rows. Very long texts take memory for one text.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    ends = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    lines = docs.agg(F.sum(ends)).first()[0] or 1
    cells = int(min(max_cells, max(SEGMENT, 1 << (CELLS_PER_LINE * lines - 1).bit_length())))
    bits = spark.sparkContext.broadcast(twice_seen(docs, min_chars, cells))
    suspects = docs.mapInArrow(_suspects(min_chars, cells, bits), "low long, high long, doc_id long")
    # partial aggregation keeps two rows' worth of a key in each task, however many documents hold it
    repeated = suspects.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("low", "high", "first", "n")
    repeated = materialize(repeated, "repeated-lines")
    count = repeated.count()
    if count * KEY_BYTES <= broadcast_bytes:
        got = repeated.toArrow().combine_chunks()
        low, high, first = (np.asarray(got.column(i)) for i in range(3))
        low, high = low.view(np.uint64), high.view(np.uint64)
        order = np.lexsort((high, low))
        shared = spark.sparkContext.broadcast((low[order], high[order], first[order]))
        return docs.mapInArrow(_drop_broadcast(min_chars, shared), OUT)
    suspects = materialize(suspects, "suspects")
    hot = repeated.where(F.col("n") > HOT)
    key = ["low", "high"]
    if hot.isEmpty():
        found = suspects.join(repeated, key)
    else:
        marked = suspects.join(_few(hot.select(*key, "first")), key, "left")
        rest = marked.where("first is null").drop("first").join(repeated.where(F.col("n") <= HOT).select(*key, "first"), key)
        found = marked.where("first is not null").unionByName(rest)
    gone = found.where("doc_id != first").groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("gone"))
    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_drop_joined(min_chars), OUT)


#: DuckDB SQL of the query's columns over ``documents``.
ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
d AS (SELECT k.*, coalesce(first <> doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
