"""Column expressions over text that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of lines: those of Python's ``splitlines``.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: The ends of lines besides a line feed: most texts have none, and then a plain split does.
RARE_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def split_lines(text: Column) -> Column:
    """Array of lines; an end of line at the end of the text starts none; empty or null text has no line."""
    rare = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in RARE_ENDS])
    odd = F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1)
    plain = F.split(F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n", -1)
    return F.when(F.length(text) > 0, F.when(rare, odd).otherwise(plain)).otherwise(F.array().cast("array<string>"))


def around(text: Column, at: Column, reach: int = 200) -> Column:
    """The characters within ``reach`` of a place, which counts from 1."""
    first = F.greatest(at - reach, F.lit(1))
    return F.substring(text, first, at + reach - first)
