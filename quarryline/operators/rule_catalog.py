"""The rules: names, grades, and the languages that each is declared for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Engine, then rule, severity, confidence, whether it blocks, languages.
TABLE = """
[defect]
DEAD-CODE low medium no py java js ts go cpp cs lua rust
EMPTY-EXCEPT medium high no py java js ts cpp cs go
PRINT-DEBUG low medium no py java js ts go cpp cs lua rust
ASSERT-USED info medium no py java js ts cpp cs lua rust
BROAD-EXCEPT medium high no py java js ts cs cpp
BARE-EXCEPT high high no py cpp
SYNTAX-ERROR high high no py java js ts
LOG-ONLY-EXCEPT medium high no py java js ts cpp go
RESOURCE-LEAK high high no py java cpp go js ts
GO-ERROR-IGNORED high high no go
GO-DEFER-IN-LOOP high high no go
JS-UNHANDLED-PROMISE medium medium no js ts
UNREACHABLE-CODE medium high no py java js ts cpp go lua
POSSIBLE-NONE-DEREF high medium no py java cpp go js ts
SUSPICIOUS-BOOLEAN-BITWISE medium high no java
DIVISION-BY-ZERO-RISK medium medium no py java cpp go
COLLECTION-INDEX-OUT-OF-BOUNDS high high no py java cpp go
SWALLOWED-EXCEPTION-FLOW medium medium no py java cpp go
STATIC-MUTABLE-SHARED-STATE medium medium no java
RESOURCE-CLOSE-NOT-GUARANTEED medium medium no py java cpp go
UNUSED-VARIABLE low medium no py java cpp go js ts lua
ALWAYS-TRUE-FALSE medium high no py
EXCEPTION-NOT-RAISED high high no py
MUTABLE-DEFAULT-ARG medium high no py
EXCEPTION-SWALLOWED-NO-LOG low medium no py
SUBPROCESS-SHELL-TRUE low high no py
SELF-ASSIGNMENT medium high no py java cpp go js ts lua
REDEFINE-IN-LOOP medium medium no py
EXCEPTION-LOST-CONTEXT medium high no py
INFINITE-RECURSION-RISK critical high no py java cpp go js ts lua
INFINITE-LOOP-RISK high medium no py java cpp go js ts
MISSING-SUPER-INIT medium medium no py java cpp
IDENTIFIER-TYPO low high no py
BOOL-PREFIX-NO-BOOL-RETURN medium high no py
GETTER-HAS-SIDE-EFFECT medium medium no py
SETTER-RETURNS-VALUE low high no py
ASYNC-VOID high high no cs
STUB-IN-PROD high high no py java js ts go cs rust cpp
PYTHON-LOCK-NO-RELEASE high medium no py
HTTP-NO-STATUS-CHECK medium medium no py
DICT-ITERATE-MUTATE high high no py
DUPLICATE-DICT-KEY high high no py
JAVA-STRING-EQ-OPERATOR high high no java
FOREACH-COLLECTION-MUTATE high high no java cs
GO-RANGE-LOOP-VAR-ADDR high high no go
GO-CHANNEL-SEND-AFTER-CLOSE critical high no go
CPP-USE-AFTER-FREE critical medium no cpp
CPP-DOUBLE-FREE critical medium no cpp
CPP-DELETE-MISMATCH high high no cpp
JAVA-HASHCODE-EQUALS-MISMATCH high high no java
JAVA-EQUALS-ON-ARRAY high medium no java
JAVA-INTEGER-BOXING-EQ high medium no java
GO-NIL-MAP-WRITE critical medium no go
MONEY-FLOAT-PRECISION high medium no java cs js ts py go
BIGDECIMAL-DOUBLE-CTOR high high no java
EXECUTOR-NOT-SHUTDOWN high medium no java
STATIC-SIMPLEDATEFORMAT high high no java
MISSING-CHARSET medium medium no java
MISSING-TIMEZONE medium medium no java
SWITCH-NO-DEFAULT medium medium no java
LIKE-PATTERN-ESCAPE high high no java
UTF8-BYTE-TRUNCATE medium medium no java
INTEGER-DIVISION-PRECISION medium medium no java
INTEGER-MULT-OVERFLOW high medium no java
EQUALS-INCOMPLETE-FIELDS medium medium no java
RESULT-RETURN-NULL high high no java
NEGATIVE-QUANTITY-RETURN medium medium no java
DIVISION-BY-COLLECTION-SIZE medium medium no java
GROWTH-RATE-DIVIDE-BY-ZERO medium medium no java
INT-ACCUMULATE-LONG medium medium no java
CHAINED-GETTER-DEREF medium low no java
RESULT-OK-NULLABLE high medium no java
NULLABLE-VALUE-USE medium medium no java
EMPTY-LOOP-BODY medium high no java
LOOP-ROW-DML medium medium no java
LOOP-NEW-THREAD medium medium no java
FACTORY-RETURN-NULL medium medium no java
N-PLUS-ONE-QUERY medium medium no java
NON-THREAD-SAFE-SUBSCRIBER-LIST medium low no java
NON-ATOMIC-FIELD-ACCUMULATE medium low no java
FOR-UPDATE-NO-NOWAIT medium medium no java
DEAD-LETTER-QUEUE-NEVER-CONSUMED medium medium no java
RECURSION-NO-BOUNDARY-GUARD medium medium no java
PUBLISH-BEFORE-PERSIST medium low no java
BATCH-FAILURE-SWALLOWED medium medium no java
CROSS-JOIN-SELF-ON medium medium no java
GETTER-SPAWNS-THREAD medium medium no java
BROADCAST-ROW-SEND medium low no java
CACHE-GET-OR-LOAD-NO-LOCK medium medium no java
RATE-LIMIT-TOCTOU medium medium no java
LOOP-LOCK-NO-SORT medium medium no java
CACHE-NO-CLEANUP medium low no java
WINDOW-FLUSH-DOUBLE-COUNT medium medium no java
ASSIGNMENT-IN-CONDITION medium medium no java
CONSTANT-RETURN-IN-GUARD medium medium no java
INSECURE-STRING-HASH medium medium no java
PAGINATION-INTEGER-DIVISION medium medium no java
NULL-BRANCH-RETURN-OK medium medium no java
SAFE-METHOD-RETURNS-NULLABLE medium medium no java
CSV-INJECTION medium medium no java
QUANTITY-ADD-OVERFLOW medium medium no java
[security]
HARDCODED-PASSWORD critical high yes py java js ts go cpp cs lua rust ruby
SQL-INJECTION-RISK critical medium yes py java js ts go cpp cs lua rust ruby
EVAL-USAGE high high no py js ts lua
WEAK-HASH medium high no py java js ts go cpp cs
INSECURE-RANDOM medium medium no py java js ts go cpp cs lua
PATH-TRAVERSAL-RISK high medium no py java js ts go cpp cs lua rust
COMMAND-INJECTION-RISK critical high yes py java js ts go cpp cs lua rust
UNSAFE-DESERIALIZATION high high yes py java cs js ts
WEAK-CIPHER high high no py java js ts go cpp cs
INSECURE-TLS-VERIFICATION critical high yes py java js ts go cs
SSRF-RISK high medium no py java js ts go
[performance]
HTTP-NO-TIMEOUT medium high no py java go js ts
BUSY-WAIT high high no py java go cpp
RETRY-WITHOUT-BACKOFF medium medium no py java go js ts
BLOCKING-CALL-IN-ASYNC high high no py js ts
UNBOUNDED-GOROUTINE high medium no go
MUTEX-LOCK-NO-UNLOCK high high no go cpp
SELECT-STAR-NO-LIMIT medium medium no py java js ts go cpp
SQL-IN-LOOP high high no py java js ts go
REDOS-RISK high medium no py java js ts go cpp
TRANSACTION-SCOPE-TOO-LARGE medium medium no py java
MISSING-PAGINATION medium medium no py java js ts go
IO-IN-LOCK high high no py
[config_risk]
CONFIG-HARDCODED-SECRET critical high yes any
DEBUG-MODE-ENABLED high high yes any
ENV-FILE-TRACKED high medium no any
DOCKERFILE-ROOT-USER medium high no any
DOCKER-LATEST-TAG medium high no any
CORS-WILDCARD medium high no any
MISSING-RESOURCE-LIMIT medium medium no any
SENSITIVE-LOG-OUTPUT high medium no any
[oo_design]
GOD-CLASS low high no any
DATA-CLASS low medium no any
DEEP-INHERITANCE low high no any
HIGH-CLASS-COUPLING low high no any
ISP-VIOLATION low medium no any
DIP-VIOLATION low medium no any
FEATURE-ENVY low low no any
[dependency]
CIRCULAR-DEPENDENCY high high no any
HIGH-FAN-OUT medium high no any
UNSTABLE-DEPENDENCY medium medium no any
[cross_function]
NULL-PROP-UNCHECKED high medium no py java go js ts
RESOURCE-NEVER-CLOSED-XFUNC high medium no py java go cpp
RESOURCE-LEAK-ON-EXCEPTION high medium no py java go cpp
TAINT-CROSS-FUNCTION critical medium yes py java go
UNCAUGHT-EXCEPTION-PROPAGATION medium medium no py java js ts
LOCK-LEAKED-ON-CALLEE-THROW high medium no py java go
ERROR-RETURN-IGNORED medium low no py java go
[business_process]
BIZ-NO-TRANSACTION-BOUNDARY high medium no py java go
BIZ-PARTIAL-FAILURE-RISK high medium no py java go
BIZ-CASCADING-TIMEOUT medium medium no py java go
BIZ-SENSITIVE-NO-AUDIT medium low no py java go
BIZ-MULTI-ENTRY-NO-AUTH high medium no py java go
BIZ-NOT-IDEMPOTENT medium low no py java go
BIZ-ERROR-SWALLOWED-MIDFLOW high medium no py java go
BIZ-READ-WRITE-NO-LOCK high low no py java go
BIZ-IO-IN-LOOP high medium no py java go
BIZ-SENSITIVE-DATA-LEAK high medium no py java go
[complexity]
HIGH-CC-FUNCTION medium high no any
LONG-FUNCTION medium high no any
DEEP-NESTING medium high no any
TOO-MANY-PARAMS low high no any
[git]
GIT-HOTSPOT medium medium no any
OWNERSHIP-RISK medium medium no any
[testing]
LOW-PROJECT-COVERAGE medium high no any
LOW-FILE-COVERAGE medium high no any
LOW-CHANGE-COVERAGE medium high no any
TEST-NO-ASSERTION medium medium no py
"""
SHORT = {"py": "python", "js": "javascript", "ts": "typescript", "cs": "csharp"}
CATEGORY = {"security": "security", "performance": "performance", "config_risk": "config_risk", "oo_design": "architecture", "dependency": "architecture", "complexity": "maintainability", "git": "maintainability", "testing": "testing"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    engine: str
    severity: str
    confidence: str
    blocks: bool
    languages: tuple[str, ...]  # none: any

    @property
    def category(self) -> str:
        return CATEGORY.get(self.engine, "defect")


def _read(table: str) -> dict[str, Rule]:
    out, engine = {}, ""
    for row in table.split("\n"):
        if row.startswith("["):
            engine = row.strip("[]")
        elif row:
            name, severity, confidence, blocks, *languages = row.split()
            out[name] = Rule(name, engine, severity, confidence, blocks == "yes", tuple(SHORT.get(x, x) for x in languages if x != "any"))
    return out


RULES = _read(TABLE)


def rule_table(spark: SparkSession) -> DataFrame:
    """``rule_id, engine, category, severity, confidence, blocks, languages``, a row a rule."""
    rows = [(r.rule_id, r.engine, r.category, r.severity, r.confidence, r.blocks, list(r.languages)) for r in RULES.values()]
    return spark.createDataFrame(rows, "rule_id string, engine string, category string, severity string, confidence string, blocks boolean, languages array<string>")
