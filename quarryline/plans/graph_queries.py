"""Paths, cycles and components over parts that follow each other in an order, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import cycles, fixpoint, paths, types
from quarryline.operators.joins import sized
from quarryline.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of ``t``, which reads a table by name, with its SQL."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: sized(table(spark, sf_dir, name)))

        QUERIES[make.__name__] = run
        ORACLES[make.__name__] = sql
        return make

    return register


# A line's part leads to the part of the next line of its order; the less the first is reduced and taxed, the surer.
SQL_PART_EDGES = """pe AS (SELECT caller, callee, max(confidence) AS confidence FROM (SELECT a.l_partkey AS caller, b.l_partkey AS callee, round(1 - a.l_discount - a.l_tax, 2) AS confidence
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) WHERE confidence >= 0.96 AND caller <> callee GROUP BY 1, 2)"""


def part_edges(t) -> DataFrame:
    line = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("caller"), F.round(1 - F.col("l_discount") - F.col("l_tax"), 2).alias("confidence"))
    following = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    both = line.where(F.col("confidence") >= 0.96).join(following, ["l_orderkey", "l_linenumber"]).where("caller <> callee")
    return both.groupBy("caller", "callee").agg(F.max("confidence").alias("confidence"))


@query(f"""WITH RECURSIVE {SQL_PART_EDGES}, s AS (SELECT p_partkey AS node FROM part WHERE p_size = 1), k AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#2'),
w(source, node, path, confidence, hops) AS (SELECT node, node, [node], 1.0::DOUBLE, 0 FROM s
  UNION ALL SELECT source, node, path, confidence, hops FROM (SELECT w.source, pe.callee AS node, list_append(w.path, pe.callee) AS path, least(w.confidence, pe.confidence) AS confidence, w.hops + 1 AS hops
    FROM w JOIN pe ON w.node = pe.caller WHERE w.hops < 4 AND NOT list_contains(w.path, pe.callee)) QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY confidence DESC, path) <= 3)
SELECT source, node AS sink, row_number() OVER (PARTITION BY source, node ORDER BY confidence DESC, hops, path)::INT AS place, array_to_string(path, '>') AS path, hops, confidence
FROM w JOIN k USING (node) WHERE hops > 0 QUALIFY place <= 3""")
def paths_to_brand(t):
    """The three surest ways of up to four hops from each part of size 1 to each part of a brand."""
    parts = t("part")
    found = paths.best_paths(part_edges(t), parts.where("p_size = 1").select(F.col("p_partkey").alias("node")), parts.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("node")), k=3, depth=4)
    return found.select("source", "sink", "place", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "confidence")


SQL_STRONG = """r(origin, node) AS (SELECT caller, callee FROM pe UNION SELECT origin, callee FROM r JOIN pe ON node = caller),
m AS (SELECT a.origin AS node, min(a.node) AS component FROM r a JOIN r b ON a.origin = b.node AND a.node = b.origin GROUP BY 1)"""


@query(f"WITH RECURSIVE {SQL_PART_EDGES}, {SQL_STRONG} SELECT node, component FROM m")
def mutual_reach(t):
    """The parts that lie on a cycle, with the smallest part of their component."""
    return cycles.strong_components(part_edges(t))


@query(f"""WITH RECURSIVE {SQL_PART_EDGES}, {SQL_STRONG}, i AS (SELECT caller, callee, a.component FROM pe JOIN m a ON a.node = caller JOIN m b ON b.node = callee WHERE a.component = b.component),
w(component, path, closed) AS (SELECT component, [caller, callee], false FROM i WHERE callee > caller
  UNION ALL SELECT w.component, CASE WHEN i.callee = w.path[1] THEN w.path ELSE list_append(w.path, i.callee) END, i.callee = w.path[1] FROM w JOIN i ON i.caller = w.path[-1]
  WHERE NOT w.closed AND (i.callee = w.path[1] AND len(w.path) <= 4 OR i.callee > w.path[1] AND len(w.path) < 4 AND NOT list_contains(w.path, i.callee)))
SELECT component, row_number() OVER (PARTITION BY component ORDER BY len(path), path)::INT AS place, array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM w WHERE closed QUALIFY place <= 10""")
def cycle_lists(t):
    """The ten shortest cycles, of up to four parts, of each component."""
    found = cycles.cycle_lists(part_edges(t), longest=4, most=10)
    return found.select("component", "place", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length")


@query(f"""WITH RECURSIVE {SQL_PART_EDGES}, ways AS (SELECT caller, callee, fact FROM pe, (VALUES ('ECONOMY', 0.96), ('PROMO', 0.97), ('STANDARD', 0.98)) f(fact, least) WHERE confidence >= least),
stops AS (SELECT p_partkey AS node, 'ECONOMY' AS fact, NULL::VARCHAR AS value FROM part WHERE p_size BETWEEN 20 AND 30 UNION ALL SELECT p_partkey, 'PROMO', p_brand FROM part WHERE p_size <= 25),
m(node, fact, value, round) AS (SELECT p_partkey, p_type, p_brand, 0 FROM part WHERE p_retailprice >= 905
  UNION SELECT w.caller, m.fact, m.value, m.round + 1 FROM m JOIN ways w ON w.callee = m.node AND w.fact = m.fact
    WHERE m.round < 12 AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.node = w.caller AND s.fact = m.fact AND (s.value IS NULL OR s.value = m.value)))
SELECT node, fact, value, min(round) AS round FROM m GROUP BY 1, 2, 3""")
def facts_along_calls(t):
    """Three kinds of parts whose brands move to the parts before them, up to twelve calls, past no part that stops them."""
    parts, edges = t("part"), part_edges(t)
    kinds = F.when(F.col("confidence") >= 0.98, F.array(*map(F.lit, ("ECONOMY", "PROMO", "STANDARD")))).when(F.col("confidence") >= 0.97, F.array(F.lit("ECONOMY"), F.lit("PROMO"))).otherwise(F.array(F.lit("ECONOMY")))
    ways = edges.select("caller", "callee", F.explode(kinds).alias("fact"))
    seeds = parts.where("p_retailprice >= 905").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("fact"), F.col("p_brand").alias("value"))
    whole = parts.where("p_size between 20 and 30").select(F.col("p_partkey").alias("node"), F.lit("ECONOMY").alias("fact"), F.lit(None).cast("string").alias("value"))
    some = parts.where("p_size <= 25").select(F.col("p_partkey").alias("node"), F.lit("PROMO").alias("fact"), F.col("p_brand").alias("value"))
    return fixpoint.moved(seeds, ways, whole.unionByName(some), rounds=12)


# Suppliers are classes in a tree, orders are functions of their customers' nations' first supplier; lines declare, copy and call.
SQL_PROGRAM = """cls AS (SELECT s_suppkey AS class, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent, s_nationkey FROM supplier),
meth AS (SELECT DISTINCT l_suppkey AS class, 'm' || l_linenumber || substr(p_brand, 7) AS name, l_suppkey || '.m' || l_linenumber || substr(p_brand, 7) AS qualified FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49),
home AS (SELECT c_nationkey AS nation, min(s_suppkey) AS class FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1),
fn AS (SELECT o_orderkey AS node, class, o_orderpriority AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN home ON nation = c_nationkey),
site AS (SELECT DISTINCT l_orderkey AS node, path, class, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity >= 40 THEN 'super' ELSE 'self' END WHEN 'R' THEN 'self.f' || l_linenumber ELSE 'v' || l_linenumber END AS receiver, 'm' || l_linenumber || substr(p_brand, 7) AS callee
  FROM lineitem JOIN fn ON l_orderkey = node JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 35),
decl AS (SELECT 'c' || s_suppkey AS scope, 'f' || (s_nationkey % 7 + 1) AS name, s_suppkey // 2 AS type FROM supplier
  UNION SELECT 'o' || l_orderkey, 'v' || l_linenumber, l_suppkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 25),
assg AS (SELECT DISTINCT 'o' || l_orderkey AS scope, 'v' || l_linenumber AS name, CASE WHEN l_quantity < 30 THEN 'o' || l_orderkey ELSE 'c' || class END AS from_scope, CASE WHEN l_quantity < 30 THEN 'v' || (l_linenumber - 1) ELSE 'f' || l_linenumber END AS from_name
  FROM lineitem JOIN fn ON l_orderkey = node WHERE l_linestatus = 'O'),
imp AS (SELECT DISTINCT path, l_suppkey AS type FROM fn JOIN lineitem ON node = l_orderkey WHERE l_tax = 0 AND l_discount = 0)"""


def _program(t):
    lines, parts = t("lineitem"), t("part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).alias("kind"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    suppliers = t("supplier").select(F.col("s_suppkey").alias("class"), F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3)).alias("parent"), "s_nationkey")
    named = lines.join(parts, "l_partkey").withColumn("name", F.concat(text("m", "l_linenumber"), "kind"))
    methods = named.where("l_quantity >= 49").select(F.col("l_suppkey").alias("class"), "name", F.concat(F.col("l_suppkey").cast("string"), F.lit("."), "name").alias("qualified")).distinct()
    home = t("customer").select(F.col("c_nationkey").alias("s_nationkey")).distinct().join(suppliers, "s_nationkey").groupBy("s_nationkey").agg(F.min("class").alias("class"))
    owners = t("customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey")).join(F.broadcast(home), "s_nationkey")  # one row a nation
    functions = t("orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "class", F.col("o_orderpriority").alias("path"))
    receiver = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_quantity") >= 40, "super").otherwise("self")).when(F.col("l_returnflag") == "R", text("self.f", "l_linenumber")).otherwise(text("v", "l_linenumber"))
    sites = named.where("l_quantity >= 35").join(functions, "l_orderkey").select(text("o", "l_orderkey").alias("node"), "path", text("c", "class").alias("class"), receiver.alias("receiver"), F.col("name").alias("callee")).distinct()
    fields = suppliers.select(text("c", "class").alias("scope"), F.concat(F.lit("f"), (F.col("s_nationkey") % 7 + 1).cast("string")).alias("name"), F.concat(F.lit("c"), F.floor(F.col("class") / 2).cast("string")).alias("type"))
    variables = lines.where("l_linestatus = 'F' and l_quantity < 25").select(text("o", "l_orderkey").alias("scope"), text("v", "l_linenumber").alias("name"), text("c", "l_suppkey").alias("type"))
    near = F.col("l_quantity") < 30
    before = F.concat(F.lit("v"), (F.col("l_linenumber") - 1).cast("string"))
    assigned = lines.where("l_linestatus = 'O'").join(functions, "l_orderkey")
    assigned = assigned.select(text("o", "l_orderkey").alias("scope"), text("v", "l_linenumber").alias("name"), F.when(near, text("o", "l_orderkey")).otherwise(text("c", "class")).alias("from_scope"), F.when(near, before).otherwise(text("f", "l_linenumber")).alias("from_name"))
    imports = lines.where("l_tax = 0 and l_discount = 0").join(functions, "l_orderkey").select("path", text("c", "l_suppkey").alias("type"))
    parents = suppliers.select(text("c", "class").alias("class"), F.concat(F.lit("c"), F.col("parent").cast("string")).alias("parent"))
    return sites, methods.withColumn("class", text("c", "class")), parents, fields.unionByName(variables), assigned, imports


SQL_TYPES = """ty(scope, name, type) AS (SELECT scope, name, type FROM decl UNION SELECT a.scope, a.name, ty.type FROM ty JOIN assg a ON a.from_scope = ty.scope AND a.from_name = ty.name)"""


@query(f"WITH RECURSIVE {SQL_PROGRAM}, {SQL_TYPES} SELECT scope, name, 'c' || type AS type FROM ty")
def names_with_types(t):
    """Types of names, declared and through assignments."""
    _, _, _, declared, assigned, _ = _program(t)
    return types.name_types(declared, assigned)


@query(f"""WITH RECURSIVE {SQL_PROGRAM}, {SQL_TYPES}, up(class, ancestor, hops) AS (SELECT class, class, 0 FROM cls UNION ALL SELECT up.class, cls.parent, hops + 1 FROM up JOIN cls ON cls.class = up.ancestor WHERE cls.parent IS NOT NULL),
inh AS (SELECT up.class, name, arg_min(qualified, (hops, ancestor)) AS qualified, min(hops) AS hops FROM up JOIN meth ON meth.class = ancestor GROUP BY 1, 2),
above AS (SELECT up.class, name, arg_min(qualified, (hops, ancestor)) AS qualified FROM up JOIN meth ON meth.class = ancestor WHERE hops > 0 GROUP BY 1, 2),
fl AS (SELECT up.class, name, ty.type, hops FROM up JOIN ty ON scope = 'c' || ancestor QUALIFY hops = min(hops) OVER (PARTITION BY up.class, name)),
hit AS (SELECT s.*, 0 AS tier, qualified AS target, CASE hops WHEN 0 THEN 0.95 ELSE 0.85 END AS confidence FROM site s JOIN inh i ON i.class = s.class AND i.name = callee WHERE receiver = 'self'
  UNION SELECT s.*, 1, qualified, 0.85 FROM site s JOIN above i ON i.class = s.class AND i.name = callee WHERE receiver = 'super'
  UNION SELECT s.*, 2, qualified, CASE WHEN imp.type IS NULL THEN 0.8 ELSE 0.85 END FROM site s JOIN fl ON fl.class = s.class AND fl.name = replace(receiver, 'self.', '') JOIN inh i ON i.class = fl.type AND i.name = callee LEFT JOIN imp ON imp.path = s.path AND imp.type = fl.type WHERE receiver NOT IN ('self', 'super')
  UNION SELECT s.*, 3, qualified, CASE WHEN imp.type IS NULL THEN 0.75 ELSE 0.8 END FROM site s JOIN ty ON scope = 'o' || s.node AND ty.name = receiver JOIN inh i ON i.class = ty.type AND i.name = callee LEFT JOIN imp ON imp.path = s.path AND imp.type = ty.type
  UNION SELECT s.*, 4, q.qualified, 0.5 FROM site s JOIN meth q ON q.name = callee WHERE receiver NOT IN ('self', 'super'))
SELECT 'o' || node AS node, path, 'c' || class AS class, receiver, callee, target, max(confidence)::DOUBLE AS confidence FROM (SELECT * FROM hit QUALIFY tier = min(tier) OVER (PARTITION BY node, path, class, receiver, callee)) GROUP BY ALL""")
def receiver_calls(t):
    """Calls on receivers with their targets, by own class, parents, fields, names of a type, or name alone."""
    sites, methods, parents, declared, assigned, imports = _program(t)
    return types.resolve_methods(sites, methods, parents, types.name_types(declared, assigned), imports)
