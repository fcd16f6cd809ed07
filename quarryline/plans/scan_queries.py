"""Ordered scans over one log, which no key divides, and lines within a budget, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import evidence, scan
from quarryline.sources.tables import table

#: Lines of orders that a task sorts.
ROWS_A_TASK = 100_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of ``t``, which reads a table by name, with its SQL."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: table(spark, sf_dir, name))

        QUERIES[make.__name__] = run
        ORACLES[make.__name__] = sql
        return make

    return register


def _log(t) -> DataFrame:
    return t("events").select(F.lit("all").alias("log"), "event_id", "ts", "event_type", "value", "user_id")


@query("""WITH s AS (SELECT ts, event_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 ELSE -1 END) OVER (ORDER BY ts, event_id) AS s FROM events)
SELECT event_id, (s - least(0, min(s) OVER (ORDER BY ts, event_id)))::BIGINT AS depth FROM s""")
def open_in_log(t):
    """How many clicks and purchases of the one log are open, where any other event closes one."""
    delta = F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(-1)
    return scan.clamped_sum(_log(t), ["log"], ["ts", "event_id"], delta, "depth").select("event_id", "depth")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' AND value > 20 THEN user_id END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS header FROM events")
def header_in_log(t):
    """The user of the last large error, carried to all that comes after it."""
    header = F.when((F.col("event_type") == "error") & (F.col("value") > 20), F.col("user_id"))
    return scan.last_seen(_log(t), ["log"], ["ts", "event_id"], header, "header").select("event_id", "header")


@query("""WITH r AS (SELECT event_id, ts, epoch_us(ts) / 1000000.0 AS came, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, round(max(came - i / 0.005) OVER (ORDER BY ts, event_id) + i / 0.005 - came, 2) AS wait FROM r""")
def paced_log(t):
    """All events as requests of one limiter, at most one in 200 seconds; how long each waits."""
    rows = _log(t).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0)
    return scan.paced(rows, ["log"], ["ts", "event_id"], "at", 0.005).select("event_id", F.round(F.col("start") - F.col("at"), 2).alias("wait"))


@query("""WITH h AS (SELECT o_orderkey AS hit, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'),
l AS (SELECT hit, 0 AS kind, lpad(l_linenumber::VARCHAR, 3, '0') || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity::BIGINT || ':' || round(l_extendedprice * 100)::BIGINT AS pos, p_name AS line FROM h JOIN lineitem ON l_orderkey = hit JOIN part ON p_partkey = l_partkey
  UNION SELECT hit, 1, lpad(o.o_orderkey::VARCHAR, 9, '0'), o.o_orderpriority FROM h JOIN orders o ON o.o_custkey = h.o_custkey AND o.o_orderkey <> hit
  UNION SELECT hit, 2, c_name, c_name FROM h JOIN customer ON c_custkey = h.o_custkey),
k AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY hit, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM l),
f AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY hit ORDER BY kind, pos ROWS UNBOUNDED PRECEDING) AS a FROM k WHERE s <= CASE kind WHEN 0 THEN 48 ELSE 24 END)
SELECT hit, kind, count(*) AS lines, sum(strlen(line) + 1)::BIGINT AS bytes, min(line) AS first_line FROM f WHERE a <= 80 GROUP BY 1, 2""")
def packed_lines(t):
    """Urgent orders as findings: their parts, their customers' other orders and the customer as three kinds of lines in 80 bytes."""
    hits = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("hit"), F.col("o_custkey").alias("who"))
    text = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    parts = max(16, t("lineitem").count() // ROWS_A_TASK)  # the session's number of tasks is fixed, whatever the tables hold
    lines = t("lineitem").repartition(parts, "l_partkey").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("hit"), F.concat_ws(":", text("l_linenumber", 3), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("at"), F.col("p_name").alias("line"))
    own = hits.join(lines.repartition(parts, "hit"), "hit").select("hit", F.lit(0).alias("kind"), "at", "line")
    others = hits.join(t("orders").select(F.col("o_custkey").alias("who"), "o_orderkey", "o_orderpriority"), "who").where("o_orderkey <> hit").select("hit", F.lit(1).alias("kind"), text("o_orderkey", 9).alias("at"), F.col("o_orderpriority").alias("line"))
    names = hits.join(t("customer").select(F.col("c_custkey").alias("who"), "c_name"), "who").select("hit", F.lit(2).alias("kind"), F.col("c_name").alias("at"), F.col("c_name").alias("line"))
    every = own.unionByName(others).unionByName(names).repartition(parts, "hit").distinct()  # equal lines lie in one part already
    fits = evidence.packed(every, "hit", 80, {0: 0.6, 1: 0.3, 2: 0.3})
    return fits.groupBy("hit", "kind").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.min("line").alias("first_line"))
