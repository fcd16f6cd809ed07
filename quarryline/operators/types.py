"""Which method a call on a receiver means: declared types, closed over assignments and parents.

Types of names start from declarations and constructors and move through
assignments in delta rounds; classes are closed over their parents in delta
rounds; a method is then looked up by type and name with equality joins. Every
class's methods, own and inherited, are one table, the nearest of each name.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.joins import paired_join, sized, sized_join
from quarryline.session import materialize

# Confidence by how the receiver is known.
OWN, PARENT, FIELD, IMPORTED_FIELD, TYPE, IMPORTED_TYPE, UNKNOWN = 0.95, 0.85, 0.8, 0.85, 0.75, 0.8, 0.5
SELF, SUPER = ("self", "this"), ("super", "super()")


def ancestors(parents: DataFrame) -> DataFrame:
    """``class, ancestor, hops`` of ``parents(class, parent)``: every class by its fewest hops up, itself at 0. Cycles end by themselves."""
    step = sized(materialize(parents.where("parent is not null and class <> parent").select("class", "parent").distinct(), "parents"))
    every = parents.select("class").union(step.select("parent")).where("class is not null").distinct()
    found = front = materialize(every.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("hops")), "ancestors")
    total = new = front.count()
    for hop in count(1):
        ahead = sized(front.select("class", "ancestor"), new).join(step.select(F.col("class").alias("ancestor"), "parent"), "ancestor").select("class", F.col("parent").alias("ancestor")).distinct()
        front = materialize(ahead.join(sized(found, total), ["class", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)), "ancestors")
        new = front.count()
        total += new
        if not new:
            return found
        found = found.unionByName(front)


def inherited(up: DataFrame, owned: DataFrame, value: str, least: int = 0) -> DataFrame:
    """``class, name``, ``value`` and ``hops``: of each name of ``owned(class, name, value)`` that a class has or inherits, the nearest; ties by ancestor, then value."""
    both = up.where(F.col("hops") >= least).join(owned.select(F.col("class").alias("ancestor"), "name", value), "ancestor")
    return both.groupBy("class", "name").agg(F.min(F.struct("hops", "ancestor", value)).alias("m")).select("class", "name", f"m.{value}", "m.hops")


def name_types(declared: DataFrame, assigned: DataFrame) -> DataFrame:
    """``scope, name, type``: the declared types of names, and those that reach them through ``assigned(scope, name, from_scope, from_name)``.

    A scope is a function, or a class for its fields. A name may have several types.
    """
    step = materialize(assigned.select("scope", "name", "from_scope", "from_name").distinct(), "assigned")
    found = front = materialize(declared.where("type is not null").select("scope", "name", "type").distinct(), "types")
    total = new = front.count()
    step = sized(step)
    while new:
        source = front.select(F.col("scope").alias("from_scope"), F.col("name").alias("from_name"), "type")
        ahead = sized_join(step, source, ["from_scope", "from_name"]).select("scope", "name", "type").distinct()
        front = materialize(ahead.join(sized(found, total), ["scope", "name", "type"], "left_anti"), "types")
        new = front.count()
        total += new
        found = found.unionByName(front)
    return found


def resolve_methods(sites: DataFrame, methods: DataFrame, parents: DataFrame, types: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """The columns of ``sites(node, path, class, receiver, callee, ...)``, and ``target, confidence``, of distinct calls on a receiver.

    ``methods(class, name, qualified)``, ``parents(class, parent)``, ``types`` as
    ``name_types`` gives them, ``imports(path, type)`` the types that a file
    imports. The first that holds:

    1. ``self`` and ``this``: own class 0.95, an ancestor 0.85; ``super``: an ancestor 0.85;
    2. a field of the class, own or inherited (``self.`` and ``this.`` may stand
       before it): the method of its type 0.8, or 0.85 if the file imports the type;
    3. a name of the function with a type, or a class's own name: 0.75, or 0.8 if imported;
    4. otherwise, but for ``self``, ``this`` and ``super``, every method of that name 0.5.

    In 2 and 3 the type's own method or the nearest ancestor's is meant; a name of
    several types has a target for each. Rows with a null receiver have none.
    """
    rows = materialize(sites.where("receiver is not null and receiver <> ''").distinct().withColumn("_site", F.xxhash64(*sites.columns)), "sites")
    rows = sized(rows)
    classes = methods.select("class").union(parents.select("class")).distinct()
    up = ancestors(parents.select("class", "parent").unionByName(classes.select("class", F.lit(None).cast(dict(parents.dtypes)["parent"]).alias("parent"))))
    up = sized(materialize(up, "up"))
    methods = sized(materialize(methods, "own-methods"))
    table = materialize(inherited(up, methods, "qualified"), "methods")
    types = sized(types)
    found: list[DataFrame] = []

    def put(hits: DataFrame) -> None:
        found.append(hits.select("_site", F.col("qualified").alias("target"), "confidence"))

    own = rows.where(F.col("receiver").isin(*SELF)).select("_site", "class", F.col("callee").alias("name"))
    put(sized_join(own, table, ["class", "name"]).withColumn("confidence", F.when(F.col("hops") == 0, OWN).otherwise(PARENT)))
    above = materialize(inherited(up, methods, "qualified", least=1), "above")
    put(sized_join(rows.where(F.col("receiver").isin(*SUPER)).select("_site", "class", F.col("callee").alias("name")), above, ["class", "name"]).withColumn("confidence", F.lit(PARENT)))

    rest = rows.where(~F.col("receiver").isin(*SELF, *SUPER))
    seen = types.select(F.col("scope").alias("class"), "name", "type")
    fields = materialize(_nearest_types(up, seen), "fields")
    by_field = sized_join(rest.select("_site", "path", "class", F.regexp_replace("receiver", r"^(?:self|this)\.", "").alias("name"), "callee"), fields, ["class", "name"])
    put(_typed(by_field, table, imports, FIELD, IMPORTED_FIELD))

    held = sized_join(rest.select("_site", "path", F.col("node").alias("scope"), F.col("receiver").alias("name"), "callee"), types.select("scope", "name", "type"), ["scope", "name"])
    named = rest.select("_site", "path", F.col("receiver").alias("type"), "callee")  # only a class of that name will match
    local = held.select("_site", "path", "type", "callee").unionByName(named)
    put(_typed(local, table, imports, TYPE, IMPORTED_TYPE))

    tiers = reduce(DataFrame.unionByName, [hits.withColumn("tier", F.lit(i)) for i, hits in enumerate(found)])
    hits = sized(materialize(tiers, "tiers"))
    won = hits.groupBy("_site").agg(F.min("tier").alias("tier"))
    best = hits.join(won, ["_site", "tier"]).groupBy("_site", "target").agg(F.max("confidence").alias("confidence"))
    sure = rows.join(best, "_site").select(*sites.columns, "target", "confidence")

    unknown = materialize(rest.join(hits.select("_site"), "_site", "left_anti").select(*sites.columns), "unknown")
    named = materialize(methods.select(F.col("name").alias("callee"), F.col("qualified").alias("target")).distinct(), "candidates")
    return sure.unionByName(paired_join(unknown, named, "callee").select(*sites.columns, "target", F.lit(UNKNOWN).alias("confidence")))


def _nearest_types(up: DataFrame, owned: DataFrame) -> DataFrame:
    """``class, name, type`` of fields, own and inherited: all types that the nearest class with the field gives it."""
    both = up.join(owned.select(F.col("class").alias("ancestor"), "name", "type"), "ancestor")
    near = both.groupBy("class", "name").agg(F.min(F.struct("hops", "ancestor")).alias("n")).select("class", "name", "n.hops", "n.ancestor")
    return both.join(near, ["class", "name", "hops", "ancestor"]).select("class", "name", "type").distinct()


def _typed(sites: DataFrame, table: DataFrame, imports: DataFrame | None, plain: float, imported: float) -> DataFrame:
    """The methods of ``sites(_site, path, type, callee)`` by their receivers' types."""
    hits = sized_join(sites.select("_site", "path", "type", F.col("callee").alias("name")), table.withColumnRenamed("class", "type"), ["type", "name"])
    if imports is None:
        return hits.withColumn("confidence", F.lit(plain))
    known = imports.select("path", "type").distinct().withColumn("_imported", F.lit(True))
    return hits.join(known, ["path", "type"], "left").withColumn("confidence", F.when(F.col("_imported"), imported).otherwise(plain))


#: A name of a type: a capital first, as classes have it in the languages read here.
_T = r"[A-Z]\w*"
_DECLARED, _BEFORE = rf"(?<![\w.])(\w+)\s*:\s*({_T})|(?<![\w.])({_T})(?:<[^<>]*>)?\s+([a-z]\w*)\s*", "(?=[=;,)])"  # what follows the second form
_MADE = rf"(?<![\w.])((?:self\.|this\.)?\w+)\s*(?::\s*[\w.]+\s*)?:?=\s*(?:new\s+|&)?({_T})\s*[({{]"
_COPIED = r"(?m)(?<![\w.])((?:self\.|this\.)?[a-z_]\w*)\s*:?=\s*((?:self\.|this\.)?[a-z_]\w*)\s*(?:;|$|#|//)"


def declarations(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``declared(path, scope, name, type)`` and ``assigned(scope, name, from_scope, from_name)`` read off the texts of ``found(node, path, owner, body)``.

    Parameters and variables with a type beside them, variables that a
    constructor makes, and plain copies. ``self.x`` and ``this.x`` are names of
    the class (``path::owner``), all others of the function.
    """
    found = found.select("node", "path", F.concat("path", F.lit("::"), "owner").alias("owner"), "body")
    # each text is searched once a pattern, and the names are read off what was found; an outer explode, as Spark would search again for a filter before an inner one
    each = lambda pattern: found.select("node", "path", "owner", F.explode_outer(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("d")).where("d is not null")
    group = lambda pattern, i: F.regexp_extract("d", f"^(?:{pattern})$", i)
    first = group(_DECLARED, 1) != ""
    typed = each(_DECLARED + _BEFORE).select("node", "path", "owner", F.when(first, group(_DECLARED, 1)).otherwise(group(_DECLARED, 4)).alias("name"), F.when(first, group(_DECLARED, 2)).otherwise(group(_DECLARED, 3)).alias("type"))
    made = each(_MADE).select("node", "path", "owner", group(_MADE, 1).alias("name"), group(_MADE, 2).alias("type"))
    of_class = lambda c: F.col(c).rlike(r"^(?:self|this)\.")
    scope = lambda c: F.when(of_class(c), F.col("owner")).otherwise(F.col("node"))
    bare = lambda c: F.regexp_replace(c, r"^(?:self|this)\.", "")
    declared = typed.unionByName(made).select("path", scope("name").alias("scope"), bare("name").alias("name"), "type").distinct()
    copied = each(_COPIED).select("node", "path", "owner", group(_COPIED, 1).alias("name"), group(_COPIED, 2).alias("other"))
    assigned = copied.select(scope("name").alias("scope"), bare("name").alias("name"), scope("other").alias("from_scope"), bare("other").alias("from_name")).distinct()
    return declared, assigned


def class_ids(named: DataFrame, classes: DataFrame, most: int = 2) -> DataFrame:
    """The rows of ``named(path, type, ...)`` with ``type`` as the ``class`` of ``classes(path, simple, class)`` that it names: those of its own file, else the first ``most`` of all; others are left out."""
    named = materialize(named, "named")
    known = materialize(classes.select(F.col("path").alias("at"), F.col("simple").alias("type"), "class").distinct(), "classes")
    first = known.withColumn("_place", F.row_number().over(Window.partitionBy("type").orderBy("class"))).where(F.col("_place") <= most)
    wanted = named.select("path", "type").distinct()
    own = wanted.join(known.withColumnRenamed("at", "path"), ["path", "type"])
    rest = wanted.join(own, ["path", "type"], "left_anti").join(first, "type").select("path", "type", "class")
    ids = materialize(own.select("path", "type", "class").unionByName(rest), "class-ids")
    return sized_join(named, ids, ["path", "type"]).drop("type").withColumnRenamed("class", "type")
