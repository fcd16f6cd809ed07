"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint is embedded as its bit counts in 16 segments of four bits. Two
fingerprints that differ in d bits have counts at a Manhattan distance of at
most d, so links are a range join on that grid, and the exact number of
differing bits is checked afterwards.

The range join at distance two is made an equality join by meeting half way:
two points of the grid at a distance of two or less have a common cell at a
distance of one or less from both. Each fingerprint goes to its own cell and the
32 beside it (``CELLS``), cells are sorted, and the members of one cell compared.

How the work is bounded:

* equal fingerprints are one class, aggregated before any shuffle of them; a
  class is a node with the smallest doc_id of its rows;
* a cell of more than ``CROWD`` classes is not compared. Its classes are embedded
  again with segments of a single bit, where a cell is a fingerprint and holds
  65 classes at most; that finds every link within a crowd, without a cap;
* a cell gives a spanning forest of its links, so links grow with the classes;
* components are contracted in the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ASCII_LOWER, slices
from quarryline.llm.components import components
from quarryline.operators.joins import SALTS
from quarryline.session import materialize, release, scratch_scope

SEED = 42
#: Links are at most so many differing bits; the half-way cells are made for this distance.
REACH = 2
CROWD = 64
#: A class of more rows than this is joined apart; there are at most rows / HOT of them.
HOT = 10_000
BROADCAST_CLASSES = 100_000


def shingles(text: bytes, ngram: int = 3) -> list[bytes]:
    """Word n-grams, repeats included, joined by a space; fewer words: the whole sequence; none: nothing."""
    words = text.translate(ASCII_LOWER).split()
    if len(words) <= ngram:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[s:e] for s, e in zip(starts[: 1 - ngram].tolist(), ends[ngram - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, ngram: int = 3, chunk: int = 8192) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64."""
    found = shingles(text, ngram)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), chunk):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found[at : at + chunk]), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view(np.uint64)[0])


def _fingerprints(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            bits = np.array([fingerprint(t, ngram) if t else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits)], ["doc_id", "bits"])

    return run


def embedded(bits: Column) -> Column:
    """The counts of the 16 four-bit segments, each plus one, as the 16 nibbles of a long."""
    part = lambda shift, keep: F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(keep))
    return bits - part(1, 0x7777777777777777) - part(2, 0x3333333333333333) - part(3, 0x1111111111111111)


#: From an embedded fingerprint to its own cell and those beside it. Nibbles stay between 0 and 6, so nothing carries over.
CELLS = [0x1111111111111111 + d for d in (0, *(s << 4 * i for i in range(16) for s in (1, -1)))]


def popcount_cells(bits: Column) -> Column:
    """Cells of the four-bit grid; the subtraction is done in halves, as a whole fingerprint may be negative."""
    low, high = bits.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(bits, 32)
    whole = F.shiftleft(embedded(high), 32) + embedded(low)
    return F.transform(F.array(*map(F.lit, CELLS)), lambda d: d + whole)


def bit_cells(bits: Column) -> Column:
    """Cells of the grid of single bits: the fingerprint and those that differ in one bit."""
    masks = [0, *(1 << i for i in range(63)), -(1 << 63)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m.bitwiseXOR(bits))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links ``a[i], b[i]`` a spanning forest needs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := find(x)) != (q := find(y)):
            root[p] = q
            keep.append(i)
    return keep


def _sweep(crowd: int):
    """Sorted ``cell, bits, node`` in; verified links ``a, b`` and members of crowded cells (``a`` bits, ``b`` node) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.empty((3, 0), np.int64)
        full: int | None = None  # the crowded cell that the rows are in
        for batch in batches:
            rows = np.concatenate([tail, np.stack([np.asarray(batch.column(i)) for i in range(3)])], axis=1)
            if full is not None:
                n = int(np.searchsorted(rows[0], full, "right"))
                yield _out(1, rows[1, :n], rows[2, :n])
                rows, full = rows[:, n:], full if n == rows.shape[1] else None
            cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            yield from _cells(rows[:, :cut], crowd)
            tail = rows[:, cut:]
            if tail.shape[1] > crowd:
                yield _out(1, tail[1], tail[2])
                full, tail = int(tail[0, 0]), tail[:, :0]
        yield from _cells(tail, crowd)

    return run


def _cells(rows: np.ndarray, crowd: int) -> Iterator[pa.RecordBatch]:
    cell, bits, node = rows
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
    sizes = np.repeat(np.diff(np.append(starts, len(cell))), np.diff(np.append(starts, len(cell))))
    wide = sizes > crowd
    if wide.any():
        yield _out(1, bits[wide], node[wide])
    cell, bits, node = cell[~wide], bits[~wide], node[~wide]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, crowd + 1):
        if not (same := cell[k:] == cell[:-k]).any():
            break
        near = same & (np.bitwise_count((bits[k:] ^ bits[:-k]).view(np.uint64)) <= REACH)
        links.append((node[:-k][near], node[k:][near]))
    if links:
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        keep = _forest(a, b)
        yield _out(0, a[keep], b[keep])


def _out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["crowded", "a", "b"])


def _swept(classes: DataFrame, cells: Callable[[Column], Column], crowd: int, tag: str) -> DataFrame:
    spread = classes.select(F.explode(cells(F.col("bits"))).alias("cell"), "bits", "node").repartition("cell").sortWithinPartitions("cell")
    return materialize(spread.mapInArrow(_sweep(crowd), "crowded byte, a long, b long"), tag)


def near_links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` of the nodes of ``classes(bits, node)``, enough of them that all within ``REACH`` bits are connected. Bits are distinct."""
    first = _swept(classes, popcount_cells, crowd, "cells")
    crowded = first.where("crowded = 1").select(F.col("a").alias("bits"), F.col("b").alias("node")).distinct()
    second = _swept(crowded, bit_cells, 65, "bit-cells")
    return first.unionAll(second).where("crowded = 0").select("a", "b")


def near_dedup(docs: DataFrame, ngram: int = 3, crowd: int = CROWD) -> DataFrame:
    """``doc_id, bits, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that
    differ in two bits or fewer, itself included.

    Null, empty or blank text: fingerprint zero, linked like any other. Null
    doc_id: never linked, component null. Rows of one doc_id with different
    texts link what their texts link. Repeated rows: each is returned. Very long
    texts: one at a time. Empty table: no rows. Other columns play no part.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    with scratch_scope() as made:
        prints = materialize(docs.mapInArrow(_fingerprints(ngram), "doc_id long, bits long"), "prints")
        named = prints.where("doc_id is not null")
        classes = materialize(named.groupBy("bits").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("top"), F.count("*").alias("n")), "classes")
        links = near_links(classes.select("bits", "node"), crowd)
        texts = named.groupBy("doc_id").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low != high").select("doc_id")  # ids with several texts
        shared = named.join(texts, "doc_id").join(classes, "bits").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        labels = components(links.unionAll(shared)).select("node", "component")
        placed = materialize(classes.join(labels, "node", "left").select("bits", "n", F.coalesce("component", "node").alias("component")), "placed")
        out = materialize(_placed(prints, placed), "simhash")
    release(docs.sparkSession, made[:-1])  # all but the result
    return out


def _placed(prints: DataFrame, placed: DataFrame) -> DataFrame:
    """Each row with its class's component; rows of large classes stay where they are."""
    hot = placed.where(F.col("n") > HOT).select("bits", F.col("component").alias("hot_component"))
    if hot.count() <= BROADCAST_CLASSES:
        prints = prints.join(F.broadcast(hot), "bits", "left")
    else:
        copies = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        prints = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, ["bits", "salt"], "left").drop("salt")
    rest = prints.where("hot_component is null").join(placed.where(F.col("n") <= HOT).select("bits", "component"), "bits", "left")
    both = prints.where("hot_component is not null").withColumn("component", F.col("hot_component")).unionByName(rest)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return both.select("doc_id", "bits", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), component.alias("component_id"))
