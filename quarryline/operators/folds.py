"""Selections whose next step depends on the last: run in order within each group, groups in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_fit(items: DataFrame, group: str, cost: str, order: list, budget: float, item: str) -> DataFrame:
    """Items in order, each taken if it fits the rest of the group's budget, else skipped: ``group, item, cost``.

    Sorted partitions are streamed, so a group of any size needs constant memory.
    """
    ordered = items.select(group, item, F.col(cost).cast("double").alias("cost"), *order).repartition(group).sortWithinPartitions(group, *order)
    kinds = [items.schema[group].dataType.simpleString(), items.schema[item].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), 0.0
        for batch in batches:
            take = []
            for g, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != now:
                    now, left = g, budget
                take.append(c is not None and c <= left)
                left -= c if take[-1] else 0.0
            yield batch.select([0, 1, 2]).filter(pa.array(take, pa.bool_()))

    return ordered.mapInArrow(run, f"`{group}` {kinds[0]}, `{item}` {kinds[1]}, cost double")


def merge_near(hits: DataFrame, key: str, at: str, rank: str, ordinal: str, span: int = 2, tags: str | None = None) -> DataFrame:
    """Greedy merge: a hit within ``span`` lines of a kept one of its key gives way to the first such, unless its rank is higher: then it takes that one's place.

    Hits come in order of ``ordinal``; a kept hit is compared as it now stands.
    With ``tags``, an array, only hits that share a tag are the same, so that a
    hit without tags always stays. Returns ``key, at, rank, ordinal`` of the
    survivors. Kept hits are found by their lines, so a hit looks at the lines
    in its reach and not at all that are kept.
    """
    chosen = hits.select(key, at, rank, ordinal, (F.col(tags) if tags else F.array(F.lit("same"))).cast("array<string>").alias("tags"))
    kinds = chosen.drop("tags").schema
    ordered = chosen.repartition(key).sortWithinPartitions(key, ordinal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, kept, lines = None, object(), [], {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], schema.field(i).type) for i in range(4)], schema=schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field(i) for i in range(4)])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if kept:
                        yield out()
                    now, kept, lines = row[0], [], {}
                mine = set(row[4] or ())
                near = [i for line in range(row[1] - span, row[1] + span + 1) for i in lines.get(line, ())] if row[1] is not None else []
                place = min((i for i in near if mine & set(kept[i][4] or ())), default=None)
                if place is None:
                    place = len(kept)
                    kept.append(row)
                elif row[2] > kept[place][2]:
                    lines[kept[place][1]].remove(place)
                    kept[place] = row
                else:
                    continue
                lines.setdefault(row[1], []).append(place)
        if kept:
            yield out()

    return ordered.mapInArrow(run, kinds)


def nesting(lines: DataFrame, key: str) -> DataFrame:
    """Deepest brace nesting of each key's lines, the depth never below 0; ``key, max_depth``.

    With s the running sum of opens less closes, the depth after each line is s
    less its least value so far (or 0), so windows express the clamp.
    """
    net = F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit(""))) - (F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit(""))))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = lines.withColumn("s", F.sum(net).over(w))
    depth = sums.withColumn("d", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    return depth.groupBy(key).agg(F.max("d").alias("max_depth"))
