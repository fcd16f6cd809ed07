"""Evidence for a finding from several functions, within one budget of bytes.

Lines come in kinds, the most telling first: those around the finding, where the
fields that its function reads are written, the calls that lead to the function,
and what the functions it calls begin with. A kind has a share of its own, and all
kinds together have the budget; lines are taken in order and whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.joins import spread_join
from quarryline.operators.types import ancestors
from quarryline.session import materialize

AROUND, WRITES, CALLERS, CALLEES = range(4)
#: Shares of the budget that each kind may take at most.
SHARES = {AROUND: 0.6, WRITES: 0.3, CALLERS: 0.3, CALLEES: 0.3}
HEAD_LINES = 8
WRITE = r"\b(?:self|this)\.(\w+)\s*(?:[-+*/|&]|<<|>>)?=(?!=)"
READ = r"\b(?:self|this)\.(\w+)\b(?!\s*\()"


def packed(lines: DataFrame, key: str, budget: int, shares: dict[int, float] = SHARES) -> DataFrame:
    """The lines ``key, kind, at, line`` that fit: of each kind, in order of ``at``, as many as its share of ``budget`` bytes holds, and of all in order of kinds as many as the budget does.

    A line counts with its end. The first line that does not fit ends its kind,
    and the first beyond the budget ends all. ``at`` tells the lines of a kind
    apart; a line's bytes are at least one, so that no kind needs more lines than
    the budget has bytes, and only so many are looked at.
    """
    order = Window.partitionBy(key, "kind").orderBy("at")
    first = lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= budget).drop("_n")
    size = F.octet_length("line") + 1
    cap = F.create_map(*[F.lit(x) for kind, share in shares.items() for x in (kind, int(share * budget))])[F.col("kind")]
    own = first.withColumn("_sum", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= cap).drop("_sum")
    every = Window.partitionBy(key).orderBy("kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("_sum", F.sum(size).over(every)).where(F.col("_sum") <= budget).select(key, "kind", "at", "line")


def body_lines(found: DataFrame) -> DataFrame:
    """``node, path, owner, line_no, line`` of functions."""
    each = found.select("node", "path", "owner", "start_line", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    return each.select("node", "path", "owner", (F.col("start_line") + F.col("i")).alias("line_no"), "line")


def field_writes(lines: DataFrame) -> DataFrame:
    """``class, field, node, line_no, line``: where a class's functions set fields of its objects; ``class`` is ``path::owner``."""
    own = lines.where((F.col("owner") != "") & F.col("line").rlike(WRITE))
    fields = F.array_distinct(F.regexp_extract_all("line", F.lit(WRITE), F.lit(1)))
    return own.select(F.concat("path", F.lit("::"), "owner").alias("class"), F.explode(fields).alias("field"), "node", "line_no", "line")


def evidence(hits: DataFrame, found: DataFrame, edges: DataFrame, parents: DataFrame | None = None, budget: int = 4000, before: int = 5, after: int = 25) -> DataFrame:
    """``hit, kind, at, line`` of ``hits(hit, node, line_no)`` in functions ``found`` with calls ``edges(caller, callee, line_no, line)``.

    Fields are looked up under the class and, with ``parents(class, parent)``, its
    ancestors; the finding's own function is left out of the writes. ``at`` is
    ``node:line`` with the line's number padded, so that it sorts.
    """
    lines = materialize(body_lines(found), "body-lines")
    place = lambda node, line: F.concat(node, F.lit(":"), F.lpad(line.cast("string"), 9, "0"))
    hits = materialize(hits.select("hit", "node", "line_no").distinct(), "hits")
    wanted = hits.select("hit", "node", F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no"))
    around = wanted.join(lines.select("node", "line_no", "line"), ["node", "line_no"]).select("hit", F.lit(AROUND).alias("kind"), place(F.col("node"), F.col("line_no")).alias("at"), "line")

    reads = found.where("owner <> ''").select("node", F.concat("path", F.lit("::"), "owner").alias("class"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(READ), F.lit(1)))).alias("field"))
    asked = hits.select("hit", "node").distinct().join(reads, "node")
    if parents is not None:
        up = ancestors(parents.unionByName(asked.select("class", F.lit(None).cast(dict(parents.dtypes)["parent"]).alias("parent"))))
        asked = asked.join(up, "class").select("hit", "node", F.col("ancestor").alias("class"), "field")
    index = field_writes(lines).withColumnRenamed("node", "writer")
    # of a field that is written everywhere only as many sites as the budget may hold
    nth = F.row_number().over(Window.partitionBy("class", "field").orderBy("writer", "line_no"))
    index = materialize(index.withColumn("_n", nth).where(F.col("_n") <= budget).drop("_n"), "field-writes")
    writes = spread_join(asked.distinct(), index, ["class", "field"], ["hit", "node"], "inner").where("writer <> node")
    writes = writes.select("hit", F.lit(WRITES).alias("kind"), place(F.col("writer"), F.col("line_no")).alias("at"), "line").distinct()

    into = edges.select(F.col("callee").alias("node"), F.col("caller"), "line_no", "line")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("caller", "line_no"))
    into = materialize(into.withColumn("_n", nth).where(F.col("_n") <= budget).drop("_n"), "callers")
    callers = spread_join(hits.select("hit", "node").distinct(), into, ["node"], ["hit"], "inner").select("hit", F.lit(CALLERS).alias("kind"), place(F.col("caller"), F.col("line_no")).alias("at"), "line").distinct()

    called = hits.select("hit", "node").distinct().join(edges.select(F.col("caller").alias("node"), "callee").distinct(), "node")
    heads = found.select(F.col("node").alias("callee"), "start_line", F.posexplode(F.slice(F.split("body", "\n"), 1, HEAD_LINES)).alias("i", "line"))
    callees = called.join(heads, "callee").select("hit", F.lit(CALLEES).alias("kind"), place(F.col("callee"), F.col("start_line") + F.col("i")).alias("at"), "line")
    return packed(reduce(DataFrame.unionByName, [around, writes, callers, callees]), "hit", budget)
