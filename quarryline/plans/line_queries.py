"""Queries over the lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.operators import lines
from quarryline.sources.tables import table


def line_metrics_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_metrics(table(spark, sf_dir, "documents"), ["lang", "source"])


#: Lines of a text as the operators split them.
_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SQL_LINES = f"CASE WHEN length(text) > 0 THEN string_split_regex(regexp_replace(text, '(?:{_END})\\z', ''), '{_END}') ELSE [] END"

QUERIES = {"line_metrics_by_lang": line_metrics_by_lang}
ORACLES = {
    "line_metrics_by_lang": f"""
WITH l AS (SELECT lang, source, regexp_replace(unnest({SQL_LINES}), '^[ \\t\\r]+', '') AS bare FROM documents)
SELECT lang, source, count(*) AS loc, sum((bare = '')::INT)::BIGINT AS blank_lines,
  sum((bare LIKE '#%' OR bare LIKE '//%')::INT)::BIGINT AS comment_lines,
  sum((bare <> '' AND bare NOT LIKE '#%')::INT)::BIGINT AS sloc
FROM l GROUP BY lang, source"""
}
