"""Facts of classes and the design rules over them; findings of functions by size and complexity."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import python_rules
from quarryline.operators.braces import brace_spans, without_literals
from quarryline.operators.code import NO_BRACES, per_file

CLASSES = "path string, name string, start_line int, end_line int, methods int, fields int, accessors int, coupling int, creations int, abstract boolean, depth int"
# Thresholds.
GOD_METHODS, GOD_LINES, DATA_FIELDS, MOST_DEPTH, MOST_COUPLING, MOST_ABSTRACT_METHODS, MOST_CREATIONS = 20, 500, 3, 5, 15, 10, 5
COMPLEX, NESTED, PARAMS, LONG = (15, 25), (5, 8), (6, 10), (60, 120)
#: Capitalised names that every program of a language has.
BUILT_IN = {"String", "Integer", "Long", "Double", "Float", "Boolean", "Object", "List", "Map", "Set", "Optional", "Override", "Exception", "None", "True", "False", "Array", "Promise", "Date", "Math", "System", "Error", "Number"}


def _depth(name: str, first_base: dict[str, str | None]) -> int:
    """Ancestors by first bases within the file, at most 21; a repeated one ends the walk."""
    seen, at = {name}, first_base.get(name)
    while at in first_base and at not in seen and len(seen) <= 21:
        seen.add(at)
        at = first_base[at]
    return len(seen) - 1


def _python_classes(text: str) -> list[tuple]:
    tree = python_rules.parse(text)
    nodes = [n for n in python_rules.below(tree, lambda _: True) if isinstance(n, ast.ClassDef)] if tree else []
    bases = {n.name: (python_rules.dotted(n.bases[0]).split(".")[-1] or None) if n.bases else None for n in nodes}
    out = []
    for n in nodes:
        methods = [f for f in n.body if isinstance(f, python_rules.FUNCTIONS)]
        inside = list(python_rules.below(n, lambda _: True))
        own = {t.attr for s in inside for t in python_rules.targets(s) if isinstance(t, ast.Attribute) and python_rules.dotted(t.value) == "self"}
        own |= {t.id for s in n.body for t in python_rules.targets(s) if isinstance(t, ast.Name)}
        plain = [f for f in methods if f.name in ("__init__", "__repr__", "__eq__", "__str__", "__hash__") or (re.match("[gs]et_", f.name) and len(f.body) == 1) or any(python_rules.dotted(d).endswith(("property", "setter")) for d in f.decorator_list)]
        names = {x.id for x in inside if isinstance(x, ast.Name)} | {x.attr for x in inside if isinstance(x, ast.Attribute)}
        used = {x for x in names if re.match("[A-Z][a-z]", x)} - BUILT_IN - {n.name}
        made = sum(isinstance(c, ast.Call) and re.fullmatch(r"(?:\w+\.)*[A-Z][a-z]\w*", python_rules.dotted(c.func)) is not None for c in inside)
        abstract = any(python_rules.dotted(b) in ("ABC", "abc.ABC", "Protocol", "typing.Protocol") for b in n.bases)
        out.append((n.name, n.lineno, n.end_lineno, len(methods), len(own), len(plain), len(used), made, abstract, _depth(n.name, bases)))
    return out


def _brace_classes(text: str) -> list[tuple]:
    spans, bare = brace_spans(text), without_literals(text)
    classes = [b for b in spans if b[0] == "class"]
    bases = {b[1]: re.sub(r"<.*", "", b[10][0]) if b[10] else None for b in classes}
    out = []
    for _, name, owner, start, end, *_, first, last in classes:
        path = f"{owner}.{name}" if owner else name
        own = [b for b in spans if b[0] == "function" and b[2] == path]
        body = bare[first:last]
        flat = body.partition("{")[2]
        while (less := re.sub(r"\{[^{}]*\}", ";", flat)) != flat:
            flat = less
        fields = len(re.findall(r"(?:^|[;{}])\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|readonly|volatile)\s+)*[\w.<>\[\],?]+(?:\s*:\s*[\w<>\[\]]+|\s+[A-Za-z_$][\w$]*)\s*(?:=[^;()]*(?:\([^;()]*\)[^;()]*)*)?(?=;)", flat))
        signatures = len(re.findall(r"[\w>\]]\s+\w+\s*\([^;{}()]*\)\s*(?:throws[^;]*)?(?=;)", flat)) - len(own)
        plain = [b for b in own if re.match(r"(?:get|set|is)[A-Z]|(?:equals|hashCode|toString)$", b[1]) and b[4] - b[3] <= 3 or b[1] == name]
        used = set(re.findall(r"\b[A-Z][a-z]\w*", body)) - BUILT_IN - {name}
        abstract = re.search(r"\binterface\b|\babstract\s+class\b", body.split("{")[0]) is not None
        out.append((name, start, end, len(own) + (max(0, signatures) if abstract else 0), fields, len(plain), len(used), len(re.findall(r"\bnew\s+[A-Z]\w*", body)), abstract, _depth(name, bases)))
    return out


def classes(files: DataFrame) -> DataFrame:
    """Facts of each class of ``path, lang, content``: methods, fields, trivial methods, other types named, objects made, depth of inheritance within the file."""
    return per_file(files, CLASSES, lambda text, lang: _python_classes(text) if lang == "python" else _brace_classes(text) if lang and lang not in NO_BRACES else [])


def class_hits(facts: DataFrame) -> DataFrame:
    """``path, rule_id, line_no, line_end`` of the design rules."""
    c = F.col
    tests = {
        "GOD-CLASS": (c("methods") >= GOD_METHODS) & (c("end_line") - c("start_line") + 1 >= GOD_LINES),
        "DATA-CLASS": (c("methods") > 0) & (c("accessors") == c("methods")) & (c("fields") >= DATA_FIELDS),
        "DEEP-INHERITANCE": c("depth") > MOST_DEPTH,
        "HIGH-CLASS-COUPLING": c("coupling") > MOST_COUPLING,
        "ISP-VIOLATION": c("abstract") & (c("methods") > MOST_ABSTRACT_METHODS),
        "DIP-VIOLATION": c("creations") > MOST_CREATIONS,
    }
    return _exploded(facts, tests).select("path", "rule_id", c("start_line").alias("line_no"), c("end_line").alias("line_end"))


def _exploded(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return df.withColumn("rule_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()]))))


def function_findings(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """One finding for each function above a threshold: ``path, name, rule_id, severity, line_no, line_end``.

    Named by the first of complexity, length, nesting and parameters that is too
    high; medium where one of the first three passes its upper threshold, else
    low. ``most`` keeps the first so many by complexity, path and line.
    """
    lines = F.col("end_line") - F.col("start_line") + 1
    over = lambda value, at: value >= at
    rule = F.when(over(F.col("complexity"), COMPLEX[0]), "HIGH-CC-FUNCTION").when(over(lines, LONG[0]), "LONG-FUNCTION").when(over(F.col("nesting"), NESTED[0]), "DEEP-NESTING").when(over(F.col("params"), PARAMS[0]), "TOO-MANY-PARAMS")
    grave = over(F.col("complexity"), COMPLEX[1]) | over(F.col("nesting"), NESTED[1]) | over(lines, LONG[1])
    found = blocks.where("kind = 'function'").withColumn("rule_id", rule).where("rule_id is not null")
    if most is not None:
        found = found.orderBy(F.desc("complexity"), "path", "start_line").limit(most)
    return found.select("path", "name", "rule_id", F.when(grave, "medium").otherwise("low").alias("severity"), F.col("start_line").alias("line_no"), F.col("end_line").alias("line_end"))


def complexity_metrics(blocks: DataFrame) -> DataFrame:
    """One row over all functions: mean and largest complexity, mean cognitive load, deepest nesting, most parameters; 0 without functions."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    return blocks.where("kind = 'function'").agg(
        F.count("*").alias("functions"),
        mean("complexity").alias("mean_complexity"),
        most("complexity").alias("max_complexity"),
        mean("cognitive").alias("mean_cognitive"),
        most("nesting").alias("max_nesting"),
        most("params").alias("max_params"),
    )
