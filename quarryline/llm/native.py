"""Small helpers for expressions inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


#: Space and \x09-\x0D, for Java's expressions and DuckDB's.
BLANKS = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Array of the runs of anything but blanks, in lower case; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS, -1), lambda w: w != "")


def quoted(names: list[str]) -> list[str]:
    """Column names as expressions, whatever characters they hold."""
    return [f"`{n.replace('`', '``')}`" for n in names]
