"""What each function does, who calls it, and the rules that follow from both.

A function's summary is read off its own text by Spark's expressions; what its
callees do is added over the call edges. ``node`` names a function:
``path::Class.name``. Walks have a bounded number of hops and start from few
functions; each hop is written, so that none is computed twice.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import fixpoint, python_rules, types
from quarryline.operators.braces import brace_spans, without_comments
from quarryline.operators.code import NO_BRACES, per_file
from quarryline.operators.findings import resolve_calls
from quarryline.session import materialize

FUNCTIONS = "path string, lang string, name string, owner string, start_line int, end_line int, head_lines int, body string"

#: Flags of a summary: what a function's text has.
FLAGS = {
    "may_null": r"\breturn\s+(?:None|null|nil|undefined)\b",
    "throws": r"\b(?:raise|throw)\b|\bpanic\s*\(",
    "catches": r"\bexcept\b|\bcatch\b|\brecover\s*\(\s*\)",
    "swallows": r"\bexcept\s*:|\bexcept\s+(?:Base)?Exception\b|\bcatch\s*\(\s*(?:final\s+)?(?:Exception|Throwable)\b|\brecover\s*\(\s*\)",
    "acquires": r"(?<![\w.])open\s*\(|\bfopen\s*\(|\bos\.(?:Open|Create)\s*\(|\bnew\s+File\w*(?:Stream|Reader|Writer)\s*\(|\bgetConnection\s*\(|\.connect\s*\(",
    "releases": r"(?i)\.close\s*\(|\bfclose\s*\(|\.release\s*\(|\.disconnect\s*\(",
    "ensured": r"\bwith\b|\bfinally\b|\bdefer\b|\btry\s*\(|\busing\s*\(",
    "locks": r"(?i)\.(?:acquire|lock|rlock)\s*\(\s*\)",
    "source": r"\brequest\.(?:args|form|json|values|GET|POST)|\bgetParameter\s*\(|(?<![\w.])input\s*\(|\.FormValue\s*\(|\bsys\.argv|\bos\.Args",
    "sink": r"\.execute\w*\s*\(|\bos\.system\s*\(|\bexec\s*\(|\beval\s*\(|\.(?:Query|Exec)\s*\(|\bsubprocess\.\w+\s*\(",
    "sanitizes": r"(?i)escape|sanitiz|quote\s*\(|validate|allow_?list",
    "writes": r"(?i)\.(?:save|insert|update|delete|persist|merge)\w*\s*\(|\binsert\s+into\b|\bupdate\s+\w+\s+set\b",
    "in_transaction": r"(?i)@transactional|\btransaction|\batomic\b|\bbegin(?:_?tx)?\s*\(|\.commit\s*\(",
    "remote": r"(?i)\b(?:requests|httpx|http_?client|rest_?template|web_?client|http|axios)\.\w+\s*\(|\bfetch\s*\(|\burlopen\s*\(",
    "io": r"(?i)\b(?:requests|httpx|http|rest_?template)\.\w+\s*\(|(?<!\w)open\s*\(|\.(?:execute|query|fetch\w*|read|send|find\w*)\s*\(",
    "sensitive": r"(?i)password|payment|transfer|credit_?card|withdraw|refund|ssn|salary",
    "audits": r"(?i)\baudit",
    "authorises": r"(?i)authori[sz]e|authenticat|permission|login_required|preauthorize|has_?role|check_?access",
    "once": r"(?i)idempoten|dedup|request_?id|nonce|unique_?key",
    "logs": r"(?i)\blog(?:ger|ging)?\.\w+\s*\(|\bprint\w*\s*\(|\bjsonify\s*\(|\bresponse\b",
    "masks": r"(?i)mask|redact|hash|encrypt",
}
HTTP_ENTRY = r"@\w+(?:\.\w+)*\.(?:route|get|post|put|patch|delete)\b|@(?:Get|Post|Put|Patch|Delete|Request)Mapping\b|\bhttp\.ResponseWriter\b"
QUEUE_ENTRY = r"@(?:Kafka|Rabbit|Jms)Listener\b|@\w+(?:\.\w+)*\.(?:task|subscribe|consumer)\b"
TIMED_ENTRY = r"@Scheduled\b|@\w+(?:\.\w+)*\.(?:scheduled|cron)\b"
MUTATING = r"(?i)^(?:create|add|update|delete|remove|submit|pay|place|transfer|save|register|refund)"
CALL = r"(?:([A-Za-z_]\w*)\s*(?:\.|->|::)\s*|(?<![\w.]))([A-Za-z_]\w*)\s*\("
NOT_CALLED = ["if", "while", "for", "switch", "catch", "return", "yield", "import", "from", "class", "def", "func", "elif", "except", "assert", "print", "function", "with"]


def _python_functions(text: str) -> list[tuple]:
    lines, out = text.split("\n"), []
    todo = [(tree, "")] if (tree := python_rules.parse(text)) else []
    while todo:
        node, owner = todo.pop()
        for n in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(n, (*python_rules.FUNCTIONS, ast.ClassDef)):
                inner = f"{owner}.{n.name}" if owner else n.name
            if isinstance(n, python_rules.FUNCTIONS):
                first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                head = max(1, n.body[0].lineno - first)
                out.append(("python", n.name, owner, first, n.end_lineno, head, "\n".join(lines[first - 1 : n.end_lineno])))
            todo.append((n, inner))
    return sorted(out, key=lambda r: r[3])


def _brace_functions(text: str, lang: str) -> list[tuple]:
    plain, out = without_comments(text), []
    for kind, name, owner, *_, first, last in brace_spans(text):
        if kind == "function":
            body = plain[first:last]
            start = plain.count("\n", 0, first) + 1
            out.append((lang, name, owner, start, start + body.count("\n"), body.split("{")[0].count("\n") + 1, body))
    return out


def functions(files: DataFrame) -> DataFrame:
    """``node``, place, head and text of each function of ``path, lang, content``, decorators and annotations included."""
    rows = per_file(files, FUNCTIONS, lambda text, lang: _python_functions(text) if lang == "python" else _brace_functions(text, lang) if lang and lang not in NO_BRACES else [])
    qualified = F.concat_ws(".", F.nullif("owner", F.lit("")), "name")
    return rows.withColumn("node", F.concat("path", F.lit("::"), qualified))


def summaries(found: DataFrame) -> DataFrame:
    """The flags of each function, how it is entered from outside, and the fields of its object that it sets and reads."""
    text, head = F.col("body"), F.col("_head")
    found = found.withColumn("_head", F.call_function("substring_index", "body", F.lit("\n"), "head_lines"))  # a column of its own, so that it is made once
    entry = F.when(head.rlike(HTTP_ENTRY), "http").when(head.rlike(QUEUE_ENTRY), "queue").when(head.rlike(TIMED_ENTRY), "timer").when(F.col("name") == "main", "main")
    fields = lambda pattern: F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)))
    whole = {flag: text.rlike(p) for flag, p in FLAGS.items()}
    returns_error = (F.col("lang") == "go") & head.rlike(r"\)\s*(?:\([^)]*\berror\s*\)|error)\s*\{?\s*$")
    whole["may_null"] &= ~head.rlike(r"\)\s*error\s*\{?\s*$")  # a Go function's only result: no error is no missing value
    return found.select(
        "node", "path", "lang", "name", "owner", "start_line", "end_line", "head_lines", "body", *[c.alias(flag) for flag, c in whole.items()], F.regexp_count("body", F.lit(FLAGS["remote"])).alias("remote_calls"),
        entry.alias("entry"), returns_error.alias("returns_error"), (~F.col("name").rlike("^_|^[a-z]") | (F.col("lang") != "go") & ~F.col("name").startswith("_")).alias("public"),
        fields(r"\b(?:self|this)\.(\w+)\s*(?:[-+]?=)(?!=)").alias("sets"), fields(r"\b(?:self|this)\.(\w+)\b(?!\s*(?:[-+]?=[^=]|\())").alias("reads"),
    )


def calls(found: DataFrame) -> DataFrame:
    """``node, path, line_no, line, receiver, callee, class`` of the calls in functions; heads, comments and lines of four quotes or more have none."""
    lines = found.select("node", "path", F.col("owner").alias("class"), "start_line", "head_lines", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    quotes = F.length("line") - F.length(F.translate("line", "\"'", ""))
    lines = lines.where((F.col("at") >= F.col("head_lines")) & F.contains("line", F.lit("(")) & (quotes < 4) & ~F.col("line").rlike(r"^\s*(#|//|\*|/\*)"))
    # each line is searched once, and the names are read off what was found; an outer explode, as Spark would search again for a filter before an inner one
    each = lines.select("node", "path", "class", (F.col("start_line") + F.col("at")).alias("line_no"), "line", F.explode_outer(F.regexp_extract_all("line", F.lit(CALL), F.lit(0))).alias("c")).where("c is not null")
    name = lambda i: F.regexp_extract("c", f"^{CALL}$", i)
    return each.select("node", "path", F.nullif("class", F.lit("")).alias("class"), "line_no", "line", name(1).alias("receiver"), name(2).alias("callee")).where(~F.col("callee").isin(NOT_CALLED)).distinct()


def receiver_types(found: DataFrame, sites: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """``scope, name, type``: the classes (``path::owner``) of names in functions and of fields; a class's own name is a name of its type.

    ``fields(path, class, name, type)`` are declared fields besides those that functions set.
    """
    classes = found.where("owner <> ''").select("path", F.element_at(F.split("owner", "[.]"), -1).alias("simple"), _class().alias("class"))
    declared, assigned = types.declarations(found)
    declared = materialize(declared, "declared")
    if fields is not None:
        declared = declared.unionByName(fields.select("path", F.concat("path", F.lit("::"), "class").alias("scope"), "name", "type"))
    static = sites.where(F.col("receiver").rlike("^[A-Z]")).select("path", F.col("node").alias("scope"), F.col("receiver").alias("name"), F.col("receiver").alias("type")).distinct()
    return types.name_types(types.class_ids(declared.unionByName(static), classes).select("scope", "name", "type"), assigned)


def _class():
    return F.when(F.col("owner") != "", F.concat("path", F.lit("::"), "owner"))


def call_edges(found: DataFrame, sites: DataFrame | None = None, parents: DataFrame | None = None, fields: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """``caller, callee, line_no, line, confidence`` between functions; a call of oneself is left out.

    Calls on a receiver go by its type (``types.resolve_methods``), others by
    name. ``parents(class, parent)`` and ``imports(path, type)`` name classes as
    ``path::owner``; ``fields`` as in ``receiver_types``.
    """
    sites = calls(found) if sites is None else sites
    sites = materialize(sites.withColumn("class", F.when(F.col("class").isNotNull(), F.concat("path", F.lit("::"), "class"))), "sites")
    symbols = materialize(found.select("path", _class().alias("class"), "name", F.col("node").alias("qualified"), F.col("owner") == "").toDF("path", "class", "name", "qualified", "free"), "symbols")
    free = resolve_calls(sites.where("receiver is null or receiver = ''").select("path", "class", "callee", "node", "line_no", "line"), symbols.drop("free"))
    methods = symbols.where("not free").select("class", "name", "qualified")
    if parents is None:
        parents = found.sparkSession.createDataFrame([], "class string, parent string")
    held = types.resolve_methods(sites.select("node", "path", "class", "receiver", "callee", "line_no", "line"), methods, parents, receiver_types(found, sites, fields), imports)
    edges = free.select("node", "target", "line_no", "line", "confidence").unionByName(held.select("node", "target", "line_no", "line", "confidence"))
    return edges.select(F.col("node").alias("caller"), F.col("target").alias("callee"), "line_no", "line", "confidence").where("caller <> callee")


def within_hops(edges: DataFrame, starts: DataFrame, hops: int, forward: bool = True, through: DataFrame | None = None) -> DataFrame:
    """``origin, node, hops``: what each start (``node``) reaches, itself included, by its fewest hops; only ``through`` the given nodes, if any."""
    a, b = ("caller", "callee") if forward else ("callee", "caller")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    if through is not None:
        step = step.join(through.select(F.col("node").alias("next")).distinct(), "next", "left_semi").select("node", "next")
    found = front = starts.select(F.col("node").alias("origin"), "node").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        ahead = front.join(step, "node").select("origin", F.col("next").alias("node")).distinct()
        front = materialize(ahead.join(found, ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)), "hop")
        found = found.unionByName(front)
    return found


#: Types that a function throws and that its handlers name; a handler of these takes all.
THROWN, CAUGHT, ALL_CAUGHT = r"\b(?:raise|throw(?:\s+new)?)\s+([A-Za-z_][\w.]*)", r"(?:\bexcept\s+\(?|\bcatch\s*\(\s*(?:final\s+)?)([\w., |]+)", ["Exception", "BaseException", "Throwable"]


def facts(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``seeds`` and ``stops`` (``node, fact, value``) of the functions: exceptions by type, null results, untrusted input, held resources."""
    last = lambda x: F.element_at(F.split(F.trim(x), "[.]"), -1)
    thrown = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(THROWN), F.lit(1)), last))
    named = F.when(F.size(thrown) > 0, thrown).when(F.col("throws"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>"))
    caught = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(CAUGHT), F.lit(1)), lambda x: F.split(x, r"\s*[,|]\s*|\s+as\s+|\s+")))
    caught = F.array_distinct(F.filter(F.transform(caught, last), lambda x: x != ""))
    one = lambda flag, name: F.when(flag, F.struct(F.lit(name).alias("fact"), F.lit("yes").alias("value")))
    whole = lambda flag, name: F.when(flag, F.struct(F.lit(name).alias("fact"), F.lit(None).cast("string").alias("value")))
    typed = lambda values: F.transform(values, lambda v: F.struct(F.lit("throws").alias("fact"), v.alias("value")))
    held = F.col("acquires") & ~F.col("releases") & ~F.col("ensured")
    own = F.concat(typed(named), F.array_compact(F.array(one(F.col("may_null"), "null"), one(F.col("source") & ~F.col("sanitizes"), "taint"), one(held, "held"))))
    every = F.col("swallows") | F.arrays_overlap(caught, F.array(*map(F.lit, ALL_CAUGHT)))
    kept = F.concat(typed(caught), F.array_compact(F.array(whole(every, "throws"), whole(F.col("sanitizes"), "taint"), whole(F.col("releases") | F.col("ensured"), "held"))))
    flat = lambda array: summary.select("node", F.explode(array).alias("f")).select("node", "f.fact", "f.value")
    return flat(own), flat(kept)


def propagated(summary: DataFrame, edges: DataFrame, passes: int | None = None) -> DataFrame:
    """The summaries with what comes over calls, until nothing is new (or ``passes`` rounds).

    ``null_result``: own, or of a callee whose result is returned.
    ``throw_result``: own throws, or a direct callee's where nothing here catches;
    ``escapes``: the types that may leave the function, its own and those of all
    callees below it less what is caught on the way, in order. ``taint_result``:
    untrusted input that comes in results, past no sanitizer; ``held_result``: a
    resource opened here or below that nothing on the way releases.
    """
    sure = materialize(edges.where("confidence >= 0.5").select("caller", "callee", "line"), "sure")
    returned, taken = F.col("line").rlike(r"^\s*return\b"), F.col("line").rlike(r"=[^=]")
    carried = F.array_compact(F.array(F.lit("throws"), F.lit("held"), F.when(returned, F.lit("null")), F.when(returned | taken, F.lit("taint"))))
    seeds, stops = facts(summary)
    moved = materialize(fixpoint.moved(seeds, sure.select("caller", "callee", F.explode(carried).alias("fact")), stops, passes), "moved")
    has = lambda fact: F.coalesce(F.max((F.col("fact") == fact).cast("int")), F.lit(0)) == 1
    types_out = F.array_sort(F.collect_set(F.when(F.col("fact") == "throws", F.col("value"))))
    come = moved.groupBy("node").agg(has("null").alias("null_result"), types_out.alias("escapes"), has("taint").alias("taint_result"), has("held").alias("held_result"))
    thrown = sure.join(summary.where("throws").select(F.col("node").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("node")).distinct().withColumn("callee_throws", F.lit(True))
    no = F.lit(False)
    out = summary.join(come, "node", "left").join(thrown, "node", "left")
    throw = F.col("throws") | (F.coalesce("callee_throws", no) & ~F.col("catches"))
    for flag in ("null_result", "taint_result", "held_result"):
        out = out.withColumn(flag, F.coalesce(flag, no))
    return out.withColumn("escapes", F.coalesce("escapes", F.array().cast("array<string>"))).withColumn("throw_result", throw).drop("callee_throws")


def _flagged(summary: DataFrame, node: str, *flags: str, where: str | None = None) -> DataFrame:
    rows = summary.where(where) if where else summary
    return rows.select(F.col("node").alias(node), *[F.col(f).alias(f"{node}_{f}") for f in flags])


def cross_function_hits(summary: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """``rule_id, node, line_no, other``: findings that need more than one function. ``summary`` is the propagated one.

    Null results that nothing tests within six lines; resources that nothing
    within three hops releases, or that a thrown exception leaks; untrusted
    input that reaches a sink over at most four sure edges past no sanitizer;
    exceptions that no caller within three hops catches below an entry; locks
    held over a callee that throws; errors of Go that a call drops.
    """
    sure = edges.where("confidence >= 0.5")
    hit = lambda df, rule, node, line, other: df.select(F.lit(rule).alias("rule_id"), F.col(node).alias("node"), line.alias("line_no"), other.alias("other")).distinct()
    none = F.lit(None).cast("string")
    place = summary.select("node", "start_line", "body")

    near = F.array_join(F.slice(F.split("body", "\n"), F.col("line_no") - F.col("start_line") + 1, F.lit(6)), "\n")
    unchecked = sure.join(_flagged(summary, "callee", where="null_result"), "callee").join(place.withColumnRenamed("node", "caller"), "caller")
    unchecked = unchecked.where(F.col("line").rlike(r"\w\s*:?=\s*[^=]") & ~near.rlike(r"(?:is|==|!=)\s*(?:not\s+)?(?:None|null|nil|undefined)\b|\bif\s+(?:not\s+)?\w+\s*[:{]|Optional|\?\."))
    out = hit(unchecked, "NULL-PROP-UNCHECKED", "caller", F.col("line_no"), F.col("callee"))

    open_ = summary.where("acquires and not releases and not ensured").select("node")
    reached = within_hops(sure, open_, 3).unionByName(within_hops(sure, open_, 3, forward=False))
    closed = reached.join(summary.where("releases").select("node"), "node", "left_semi").select(F.col("origin").alias("node")).distinct()
    never = open_.join(closed, "node", "left_anti").join(place, "node")
    linked = sure.select(F.col("caller").alias("node")).union(sure.select("callee")).distinct()
    out = out.unionByName(hit(never.join(linked, "node", "left_semi"), "RESOURCE-NEVER-CLOSED-XFUNC", "node", F.col("start_line"), none))

    throwing = _flagged(summary, "callee", where="throw_result")
    opened_at = calls_of_flag(found, "acquires")
    risky = sure.join(throwing, "callee", "left_semi").join(summary.where("acquires and not ensured").select(F.col("node").alias("caller")), "caller", "left_semi")
    leaks = risky.join(opened_at.withColumnRenamed("node", "caller"), "caller").where("line_no > opened_at")
    out = out.unionByName(hit(leaks, "RESOURCE-LEAK-ON-EXCEPTION", "caller", F.col("line_no"), F.col("callee")))

    open_ways = summary.where("not sanitizes").select("node")
    flows = within_hops(edges.where("confidence >= 0.6"), summary.where("source and not sanitizes").select("node"), 4, through=open_ways)
    flows = flows.where("hops > 0").join(summary.where("sink").select("node"), "node", "left_semi").join(place.withColumnRenamed("node", "origin"), "origin")
    out = out.unionByName(hit(flows, "TAINT-CROSS-FUNCTION", "origin", F.col("start_line"), F.col("node")))

    above = within_hops(sure, summary.where("throws and not catches").select("node"), 3, forward=False).where("hops > 0")
    caught = above.join(summary.where("catches").select("node"), "node", "left_semi").select("origin").distinct()
    entered = above.join(summary.where("entry is not null").select("node"), "node", "left_semi").select("origin").distinct()
    loose = entered.join(caught, "origin", "left_anti").join(place.withColumnRenamed("node", "origin"), "origin")
    out = out.unionByName(hit(loose, "UNCAUGHT-EXCEPTION-PROPAGATION", "origin", F.col("start_line"), none))

    held = sure.join(throwing, "callee", "left_semi").join(summary.where("locks and not ensured").select(F.col("node").alias("caller")), "caller", "left_semi")
    out = out.unionByName(hit(held, "LOCK-LEAKED-ON-CALLEE-THROW", "caller", F.col("line_no"), F.col("callee")))

    dropped = sure.join(_flagged(summary, "callee", where="returns_error"), "callee", "left_semi").join(summary.where("public").select(F.col("node").alias("caller")), "caller", "left_semi")
    dropped = dropped.where(F.col("line").rlike(r"^\s*(?:\w+\.)?\w+\s*\([^=]*\)\s*$"))
    return out.unionByName(hit(dropped, "ERROR-RETURN-IGNORED", "caller", F.col("line_no"), F.col("callee")))


def calls_of_flag(found: DataFrame, flag: str) -> DataFrame:
    """``node, opened_at``: the first line of each function that shows a flag."""
    lines = found.select("node", "start_line", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(FLAGS[flag])).groupBy("node").agg(F.min(F.col("start_line") + F.col("at")).alias("opened_at"))


def entry_points(summary: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, entry``: entered from outside by its head, or a public function that nothing calls and that calls two others at least."""
    sure = edges.where("confidence >= 0.5")
    fan = sure.groupBy(F.col("caller").alias("node")).agg(F.countDistinct("callee").alias("n")).where("n >= 2")
    free = summary.where("entry is null and public").select("node").join(fan, "node", "left_semi").join(sure.select(F.col("callee").alias("node")).distinct(), "node", "left_anti")
    return summary.where("entry is not null").select("node", "entry").unionByName(free.withColumn("entry", F.lit("public")))


def processes(summary: DataFrame, edges: DataFrame, depth: int = 8, smallest: int = 3) -> DataFrame:
    """Flows from each entry over edges of at least 0.6: ``origin, entry, node, depth`` of the flows of ``smallest`` functions or more."""
    entries = entry_points(summary, edges)
    flows = materialize(within_hops(edges.where("confidence >= 0.6"), entries, depth).withColumnRenamed("hops", "depth"), "flows")
    large = flows.groupBy("origin").agg(F.count("*").alias("n")).where(F.col("n") >= smallest).select("origin")
    return flows.join(large, "origin", "left_semi").join(entries.select(F.col("node").alias("origin"), "entry"), "origin")


def process_facts(flows: DataFrame, summary: DataFrame) -> DataFrame:
    """One row a flow: what its functions do, together."""
    kinds = ["writes", "in_transaction", "throws", "remote_calls", "sensitive", "audits", "authorises", "once", "locks"]
    rows = flows.join(summary.select("node", "name", "lang", "start_line", "swallows", "sets", "reads", *kinds), "node")
    count = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    set_by = rows.select("origin", "node", F.explode("sets").alias("field")).distinct()
    read_by = rows.select("origin", F.col("node").alias("reader"), F.explode("reads").alias("field")).distinct()
    races = set_by.join(read_by, ["origin", "field"]).where("node <> reader").groupBy("origin").agg(F.countDistinct("field").alias("raced"))
    origin = summary.select(F.col("node").alias("origin"), F.col("name").alias("origin_name"), "start_line")
    idle = F.sum((F.col("throws") & ~F.col("writes")).cast("int")).alias("throws_between")
    facts = rows.groupBy("origin", "entry").agg(F.count("*").alias("functions"), F.max("depth").alias("max_depth"), *[count(k) for k in kinds], idle)
    return facts.join(races, "origin", "left").fillna(0, ["raced"]).join(origin, "origin")


def process_hits(flows: DataFrame, facts: DataFrame, summary: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """``rule_id, node, line_no``: findings of whole flows, at the entry or, where one function is at fault, there."""
    c = F.col
    web = c("entry") == "http"
    bare = (c("writes") >= 2) & (c("in_transaction") == 0)
    touchy = (c("writes") > 0) | (c("sensitive") > 0)
    tests = {
        "BIZ-NO-TRANSACTION-BOUNDARY": bare & (c("throws_between") == 0),
        "BIZ-PARTIAL-FAILURE-RISK": bare & (c("throws_between") > 0),
        "BIZ-CASCADING-TIMEOUT": c("entry").isin("http", "public") & (c("remote_calls") >= 3),
        "BIZ-SENSITIVE-NO-AUDIT": (c("sensitive") > 0) & (c("audits") == 0),
        "BIZ-MULTI-ENTRY-NO-AUTH": web & touchy & (c("authorises") == 0),
        "BIZ-NOT-IDEMPOTENT": web & c("origin_name").rlike(MUTATING) & touchy & (c("once") == 0),
        "BIZ-READ-WRITE-NO-LOCK": c("entry").isin("http", "queue") & (c("raced") > 0) & (c("locks") == 0),
    }
    rules = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()]))
    out = facts.select(F.explode(rules).alias("rule_id"), c("origin").alias("node"), c("start_line").alias("line_no"))
    # a broad handler that lets a flow go on in its middle: the first three of a flow
    deepest = facts.select("origin", "max_depth")
    middle = flows.join(deepest, "origin").where("depth > 0 and depth < max_depth - 1").join(summary.where("swallows and not throws").select("node", "start_line"), "node")
    nth = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "node"))
    swallowed = middle.withColumn("nth", nth).where("nth <= 3").select(F.lit("BIZ-ERROR-SWALLOWED-MIDFLOW").alias("rule_id"), "node", c("start_line").alias("line_no")).distinct()
    members = flows.select("node").distinct()
    looped = io_in_loops(found).join(members, "node", "left_semi").select(F.lit("BIZ-IO-IN-LOOP").alias("rule_id"), "node", "line_no")
    shown = summary.where("logs and not masks").select("node")
    reads = summary.where("sensitive and not masks").select("node", "start_line")
    ways = within_hops(edges.where("confidence >= 0.6"), reads.select("node"), 3).join(shown, "node", "left_semi").select(c("origin").alias("node")).distinct()
    leaked = ways.join(members, "node", "left_semi").join(reads, "node").select(F.lit("BIZ-SENSITIVE-DATA-LEAK").alias("rule_id"), "node", c("start_line").alias("line_no"))
    return out.unionByName(swallowed).unionByName(looped).unionByName(leaked)


def io_in_loops(found: DataFrame) -> DataFrame:
    """``node, line_no`` of the first line of each function that does input or output deeper than a loop above it that is still open."""
    io, loop = FLAGS["io"], r"^\s*(?:for|while)\b"

    def step(state, line):
        indent = F.length(line) - F.length(F.ltrim(F.translate(line, "\t", " ")))
        open_ = F.filter(state["open"], lambda i: i < indent)  # the loops that the line is deeper than
        here = F.when((F.size(open_) > 0) & line.rlike(io), state["at"])
        after = F.when(line.rlike(loop), F.array_append(open_, indent)).otherwise(open_)
        blank = F.trim(line) == ""
        return F.struct((state["at"] + 1).alias("at"), F.when(blank, state["open"]).otherwise(after).alias("open"), F.coalesce(state["hit"], F.when(~blank, here)).alias("hit"))

    start = F.struct((F.col("start_line") + F.col("head_lines")).alias("at"), F.array().cast("array<int>").alias("open"), F.lit(None).cast("int").alias("hit"))
    inner = F.slice(F.split("body", "\n"), F.col("head_lines") + 1, F.length("body") + 1)
    return found.select("node", F.aggregate(inner, start, step)["hit"].alias("line_no")).where("line_no is not null")
