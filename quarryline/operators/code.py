"""Source code as tables: functions and classes, rule hits, call sites, imports.

Parsing runs per file in ``mapInArrow``, so nothing is shuffled and a lost task
parses its own files again. A row is one file; its text must fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import body_rules, python_rules
from quarryline.operators.braces import brace_blocks
from quarryline.operators.findings import resolve_imports
from quarryline.sources.files import package_of

BLOCKS = "path string, kind string, name string, owner string, start_line int, end_line int, params int, is_async boolean, complexity int, nesting int, cognitive int, bases array<string>"
NO_BRACES = ("ruby", "lua", "r", "config", "docker")
HITS = "path string, rule_id string, line_no int, line_end int"
#: Rows of an output batch, characters of the texts behind one, and characters of texts and their rows that a task remembers.
BATCH_ROWS, BATCH_CHARS, REMEMBERED, _SMALL = 10_000, 4_000_000, 8_000_000, 8


def per_file(files: DataFrame, schema: str, rows_of: Callable[[str, str | None], list[tuple]]) -> DataFrame:
    """``path`` and the rows of each file's text; a null text is empty. A task reads equal texts once while it remembers them."""
    spark = files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[tuple]] = {}
        rows: list[tuple] = []
        held = size = 0

        def batch_of(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (found := known.get((lang, text))) is None:
                    found = rows_of(text or "", lang)
                    cost = len(text or "") + sum(_SMALL + len(x) if isinstance(x, str) else _SMALL for r in found for x in r)
                    if cost <= REMEMBERED:
                        if held + cost > REMEMBERED:
                            known, held = {}, 0
                        known[lang, text], held = found, held + cost
                rows.extend((path, *r) for r in found)
                size += len(text or "")
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    for at in range(0, len(rows), BATCH_ROWS):
                        yield batch_of(rows[at : at + BATCH_ROWS])
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return files.select("path", "lang", "content").mapInArrow(run, schema)


def blocks(files: DataFrame) -> DataFrame:
    """Functions and classes of ``path, lang, content``: Python by its own parser, other known languages by braces."""
    return per_file(files, BLOCKS, lambda text, lang: python_rules.blocks(text) if lang == "python" else brace_blocks(text) if lang and lang not in NO_BRACES else [])


def syntax_hits(files: DataFrame) -> DataFrame:
    """``path, rule_id, line_no, line_end`` of the rules over Python's syntax trees and over the bodies of brace languages."""
    return per_file(files, HITS, lambda text, lang: python_rules.hits(text) if lang == "python" else body_rules.hits(text, lang) if lang and lang not in NO_BRACES else [])


def call_sites(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """``path, caller, line_no, form, receiver, callee`` of ``path, line_no, line`` within functions.

    A line belongs to the innermost function around it. Functions are exploded to
    their line numbers, so this is an equality join. Comments, heads and lines of
    four quotes or more have no calls.
    """
    spans = functions.where("kind = 'function'").select("path", F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("caller"), "start_line", F.explode(F.sequence(F.col("start_line"), "end_line")).alias("line_no"))
    inner = spans.groupBy("path", "line_no").agg(F.max(F.struct("start_line", "caller")).alias("f")).where("line_no > f.start_line").select("path", "line_no", "f.caller")
    usable = lines.where(~F.col("line").rlike(r"^\s*(#|//|\*|/\*)") & (F.regexp_count("line", F.lit("[\"']")) < 4))
    call = r"(new\s+)?(?:([A-Za-z_][\w]*(?:\(\))?)\s*(?:\.|->|::)\s*|(?<![\w.]))([A-Za-z_]\w*)\s*\("
    group = lambda i: F.regexp_extract_all("line", F.lit(call), F.lit(i))
    calls = usable.select("path", "line_no", F.explode(F.arrays_zip(group(1).alias("made"), group(2).alias("receiver"), group(3).alias("callee"))).alias("c")).select("path", "line_no", "c.*")
    calls = calls.where(~F.col("callee").isin("if", "while", "for", "switch", "catch", "return", "yield", "import", "from", "class", "def", "func", "elif", "except", "assert", "print"))
    form = F.when(F.col("made") != "", "constructor").when(F.col("receiver").isin("super", "super()"), "super").when(F.col("receiver") != "", "method").when(F.col("callee").rlike("^[A-Z]"), "constructor").otherwise("free")
    return calls.join(inner, ["path", "line_no"]).select("path", "caller", "line_no", form.alias("form"), F.nullif("receiver", F.lit("")).alias("receiver"), "callee")


def module_edges(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``source, target`` of distinct Python imports between the modules of ``known`` (``module, path``); others are external."""
    target = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\b", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*import\s+([\w.]+)", 1), F.lit("")))
    found = lines.select("path", target.alias("target")).where("target is not null").distinct()
    inside = known.select(F.col("module").alias("target")).distinct()
    return found.join(known, "path").join(inside, "target", "left_semi").where("module <> target").select(F.col("module").alias("source"), "target").distinct()


def imported(lines: DataFrame) -> DataFrame:
    """``path, lang, module`` of the distinct imports in ``path, lang, line`` of Python, Java and Go.

    Go: an import by itself, or a quoted path alone on its line, as in a block of imports.
    """
    take = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    python = F.coalesce(take(r"^\s*from\s+([\w.]+)\s+import\b"), take(r"^\s*import\s+([\w.]+)"))
    java = take(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;")
    go = F.coalesce(take(r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), take(r'^\s*(?:[\w.]+\s+)?"([\w./-]+)"\s*$'))
    module = F.when(F.col("lang") == "python", python).when(F.col("lang") == "java", java).when(F.col("lang") == "go", go)
    return lines.select("path", "lang", module.alias("module")).where("module is not null").distinct()


def file_edges(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``source, target``: the distinct imports of Python, Java and Go between files (``known``: ``path, lang``); others are external."""
    packages = known.select("path", package_of(F.col("path"), F.col("lang")).alias("package"))
    return resolve_imports(imported(lines), packages).select(F.col("path").alias("source"), "target").distinct()


def maintainability(loc: Column, complexity: Column) -> Column:
    """171 - 5.2 ln(8 loc) - 0.23 complexity - 16.2 ln(loc) within 0..100, for at least one line."""
    lines = F.greatest(loc, F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 171 - 5.2 * F.log(8 * lines) - 0.23 * complexity - 16.2 * F.log(lines.cast("double"))))
