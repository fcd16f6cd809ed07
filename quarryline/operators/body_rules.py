"""Rules over the bodies of functions and classes in languages with braces.

A rule is a function from a body to the places at fault in its text, most often
"this is there and that is not", with names carried from one to the other. What
follows is our own reading of each rule's name, without a grammar: a value that
travels through other functions is not followed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

from quarryline.operators.braces import brace_spans, without_comments

JAVA, GO, JS, CPP, CSHARP = ("java",), ("go",), ("javascript", "typescript"), ("cpp", "c"), ("csharp",)
NAME = r"[A-Za-z_$][\w$]*"
LOG = r"(?i:log(?:ger)?|console|print\w*|fmt|system\s*\.\s*(?:out|err)|std::c(?:out|err)|trace)"
REMOTE = r"(?i:rest_?template|http_?client|web_?client|feign\w*|kafka_?template|okhttp\w*|fetch|axios|http)\s*\.\s*\w+\s*\(|\bThread\s*\.\s*sleep\s*\("
STORE = r"(?i:repository|repo|dao|mapper|jdbc_?template|entity_?manager|session|db|conn(?:ection)?|stmt|statement|tx|pool|client)"


@dataclass
class Body:
    """A block of source: its own text, without comments, from its head to its closing brace."""

    kind: str
    name: str
    owner: str
    lang: str
    start: int
    text: str

    @cached_property
    def head(self) -> str:
        return self.text.split("{", 1)[0]

    @cached_property
    def inner(self) -> str:
        return self.text.split("{", 1)[1] if "{" in self.text else ""

    @cached_property
    def params(self) -> set[str]:
        inside = re.search(r"\(([^)]*)\)[^()]*$", self.head)
        if not inside:
            return set()
        pattern = rf"({NAME})\s+[\w.*\[\]]+\s*(?:,|$)|({NAME})\s*,(?=[^,]*\s)" if self.lang == "go" else rf"({NAME})\s*(?:[:=][^,]*)?(?:,|$)"
        return {x for m in re.finditer(pattern, inside[1]) for x in m.groups() if x}

    @cached_property
    def loops(self) -> list[tuple[int, str, str]]:
        """Place, head and body of each loop."""
        out = []
        for m in re.finditer(r"\b(?:for|while|foreach)\b|\.\s*forEach\s*\(", self.inner):
            opened = self._open_brace(m.end())
            if opened is not None:
                out.append((self._offset + m.start(), self.inner[m.end() : opened], _balanced(self.inner, opened)))
        return out

    def _open_brace(self, at: int) -> int | None:
        """The brace that a head leads to; none where a statement ends first."""
        depth = 0
        for i in range(at, len(self.inner)):
            c = self.inner[i]
            depth += (c == "(") - (c == ")")
            if c == "{":
                return i
            if c == "}" or (c == ";" and depth <= 0 and self.lang != "go") or (c == "\n" and self.lang == "go" and depth <= 0):
                return None
        return None

    @cached_property
    def _offset(self) -> int:
        return len(self.text) - len(self.inner)

    @cached_property
    def handlers(self) -> list[tuple[int, str]]:
        """Place and body of each ``catch``."""
        out = []
        for m in re.finditer(r"\bcatch\b[^{}]*\{", self.inner):
            out.append((self._offset + m.start(), _balanced(self.inner, m.end() - 1)))
        return out

    def has(self, pattern: str) -> bool:
        return re.search(pattern, self.text) is not None

    def all(self, pattern: str, flags: int = re.M) -> Iterator[re.Match]:
        return (m for m in re.finditer(pattern, self.text, flags) if m.start() >= self._offset or self.kind == "class")

    def after(self, pattern: str, at: int) -> bool:
        return re.search(pattern, self.text[at:]) is not None

    def tests(self, name: str) -> bool:
        """Whether a name is compared with nothing, or tested in some such way."""
        n = re.escape(name)
        return self.has(rf"(?<![\w.]){n}\s*[!=]=+\s*(?:null|nil|nullptr|undefined|NULL|0)\b|(?:null|nil|nullptr|NULL|0)\s*[!=]=+\s*{n}(?!\w)|\b(?:if|while|assert)\s*\(\s*!?{n}\s*(?:\)|&&|\|\|)|requireNonNull\(\s*{n}\b|\b{n}\s*\?[.?]|\b{n}\.(?:isPresent|isEmpty)\(|(?:isNull|nonNull|isEmpty|isBlank|notNull)\(\s*{n}\b|[&|]{{2}}\s*!?{n}\b(?!\.)")


def _balanced(text: str, at: int) -> str:
    """What stands between the brace at a place and its partner."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 1 : i]
    return text[at + 1 :]


Places = Iterable[int]
RULES: list[tuple[str, str, tuple[str, ...], Callable[[Body], Places]]] = []


def rule(name: str, languages: tuple[str, ...], kind: str = "function"):
    def register(find: Callable[[Body], Places]):
        RULES.append((name, kind, languages, find))
        return find

    return register


def there(pattern: str, unless: str | None = None, head: str | None = None, flags: int = re.M):
    """Places of a pattern in bodies that lack another one, and whose head has a third."""

    def find(b: Body) -> Places:
        if (unless and b.has(unless)) or (head and not re.search(head, b.head)):
            return ()
        return (m.start() for m in b.all(pattern, flags))

    return find


def in_loop(pattern: str, unless: str | None = None, head: str | None = None):
    """Loops whose body has a pattern."""

    def find(b: Body) -> Places:
        if (unless and b.has(unless)) or (head and not re.search(head, b.head)):
            return ()
        return (at for at, _, body in b.loops if re.search(pattern, body))

    return find


def declared(b: Body, value: str) -> Iterator[tuple[int, str]]:
    """Place and name of variables set to a value."""
    for m in b.all(rf"(?<![\w.])({NAME})\s*:?=\s*(?:await\s+)?(?:{value})"):
        yield m.start(), m[1]


ALL = (*JAVA, *GO, *JS, *CPP, *CSHARP)
OPENED = {
    "java": r"new\s+(?:\w*(?:InputStream|OutputStream|Reader|Writer)|Scanner|Socket|ServerSocket|RandomAccessFile)\s*\(|\w+\.getConnection\s*\(|\w+\.prepareStatement\s*\(",
    "csharp": r"new\s+(?:FileStream|StreamReader|StreamWriter|SqlConnection|TcpClient)\s*\(|File\.Open\w*\s*\(",
    "cpp": r"(?:std::)?fopen\s*\(|\bopen\s*\(|\bmalloc\s*\(|\bcalloc\s*\(|new\s+\w+",
    "c": r"fopen\s*\(|\bopen\s*\(|\bmalloc\s*\(|\bcalloc\s*\(",
    "javascript": r"fs\.openSync\s*\(|fs\.create(?:Read|Write)Stream\s*\(|net\.connect\s*\(",
    "go": r"os\.(?:Open|Create|OpenFile)\s*\(|http\.(?:Get|Post)\s*\(|net\.Dial\w*\s*\(|sql\.Open\s*\(|\w+\.Query\s*\(",
}
OPENED["typescript"] = OPENED["javascript"]


def _resources(b: Body) -> Iterator[tuple[int, str]]:
    names = rf"(?<![\w.])({NAME})(?:\s*,\s*\w+)?\s*:?=\s*(?:{OPENED[b.lang]})"
    for m in b.all(names):
        line = b.text[b.text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if not re.search(r"\b(?:try|using)\b\s*(?:\(|var\b)?|\breturn\b|_ptr", line):
            yield m.start(), m[1]


def _closed(name: str) -> str:
    n = re.escape(name)
    return rf"\b{n}\.(?:Body\.)?(?i:close|closeSync|destroy|dispose|end|shutdown)\s*\(|(?i:fclose|free|close|closeSync|closeQuietly|delete|release)\s*\(?\s*(?:\[\]\s*)?{n}\b"


def _leaves(b: Body, name: str) -> bool:
    return b.has(rf"\breturn\b[^;\n]*\b{re.escape(name)}\b|(?:this\.|->)\w+\s*=\s*{re.escape(name)}\b|unique_ptr|shared_ptr")


@rule("RESOURCE-LEAK", ALL)
def _(b: Body) -> Places:
    return (at for at, name in _resources(b) if not b.has(_closed(name)) and not _leaves(b, name))


@rule("RESOURCE-CLOSE-NOT-GUARANTEED", (*JAVA, *CPP, *GO))
def _(b: Body) -> Places:
    for at, name in _resources(b):
        closing = re.search(_closed(name), b.text[at:])
        if not closing or _leaves(b, name):
            continue
        between = b.text[at : at + closing.start()]
        if b.lang == "java" and not re.search(r"\bfinally\b", b.text[at:]):
            yield at
        elif b.lang == "go" and not re.search(r"\bdefer\b[^\n]*$", between):
            yield at
        elif b.lang in CPP and re.search(r"\breturn\b|\bthrow\b", between) and not re.search(rf"if\s*\([^)]*!?\s*{name}", between):
            yield at


@rule("GO-ERROR-IGNORED", GO)
def _(b: Body) -> Places:
    return (m.start() for m in b.all(rf"^[ \t]*(?:{NAME}\s*,\s*)*_\s*:?=\s*{NAME}(?:\.{NAME})*\(", re.M) if "range" not in m[0])


rule("GO-DEFER-IN-LOOP", GO)(lambda b: (at for at, _, body in b.loops if re.search(r"^\s*defer\b", re.sub(r"func\s*\([^)]*\)\s*\{(?:[^{}]|\{[^{}]*\})*\}\s*\(", "", body), re.M)))


@rule("JS-UNHANDLED-PROMISE", JS)
def _(b: Body) -> Places:
    for m in b.all(r"^[ \t]*(?!return\b|await\b)[\w.]+\s*(?:\([^;]*?\))?\s*\.\s*then\s*\(", re.M):
        end = b.text.find(";", m.end())
        if not re.search(r"\.\s*(?:catch|finally)\s*\(", b.text[m.start() : end if end >= 0 else None]):
            yield m.start()


MAYBE = {
    "java": r"\w+\.(?:get|find\w*|getParameter|getAttribute|getHeader|getProperty|poll|peek)\s*\([^;]*\)\s*;|System\.getenv\s*\([^;]*;",
    "javascript": r"(?:document\.(?:getElementById|querySelector)|\w+\.(?:find|match|exec|pop|shift))\s*\([^;]*\)\s*;?",
    "cpp": r"(?:nullptr|NULL|0)\s*;|dynamic_cast\s*<|(?:std::)?malloc\s*\(|\w*[Ff]ind\w*\s*\(",
    "go": r"nil\b|\w+\[[^\]]+\]\s*$",
}
MAYBE["typescript"], MAYBE["c"] = MAYBE["javascript"], MAYBE["cpp"]


@rule("POSSIBLE-NONE-DEREF", (*JAVA, *JS, *CPP, *GO))
def _(b: Body) -> Places:
    for at, name in declared(b, MAYBE[b.lang]):
        use = re.search(rf"(?<![\w.]){re.escape(name)}\s*(?:->|\.)\s*\w", b.text[at + len(name) :])
        if use and not b.tests(name) and not (b.lang == "java" and b.has(r"Optional|\.orElse")):
            yield at + len(name) + use.start()
    if b.lang == "go":  # used before its error has been looked at
        for m in b.all(rf"^[ \t]*({NAME})\s*,\s*(err\w*)\s*:?=", re.M):
            rest = b.text[m.end() :].split("\n", 2)
            if len(rest) > 1 and re.search(rf"\b{m[1]}\.\w", rest[1]) and not re.search(rf"\b{m[2]}\b", rest[1]):
                yield m.end() + len(rest[0]) + 1


rule("SUSPICIOUS-BOOLEAN-BITWISE", JAVA)(there(r"\b(?:if|while)\s*\(.*(?:[<>]=?\s*[\w.]+|[!=]=\s*[\w.\"]+|\(\s*\)|\b(?:true|false))\s*(?<![&|])[&|](?![&|=])\s*[\w!(].*\)"))


@rule("DIVISION-BY-ZERO-RISK", (*JAVA, *CPP, *GO))
def _(b: Body) -> Places:
    for m in b.all(rf"[\w)\]]\s*[/%]\s*({NAME})\b(?!\s*[.(\[\w\"'/])"):
        if m[1] in b.params and not b.has(rf"\b{m[1]}\s*(?:[!=]=|[<>]=?)\s*0|\b0\s*(?:[!=]=|[<>])\s*{m[1]}\b|(?:signum|max)\s*\([^)]*\b{m[1]}\b"):
            yield m.start()
    yield from (m.start() for m in b.all(r"[\w)]\s*[/%]\s*0(?![\w.xX])"))


@rule("COLLECTION-INDEX-OUT-OF-BOUNDS", (*JAVA, *CPP, *GO))
def _(b: Body) -> Places:
    size = r"(?:\1\.(?:size\(\)|length\(\)|length)|len\(\1\))"
    yield from (m.start() for m in b.all(rf"\b({NAME})(?:\[|\.(?:get|at|charAt)\(\s*){size}\s*[\])]"))
    yield from (m.start() for m in b.all(rf"\bfor\b[^{{]*<=\s*(?:len\(\s*{NAME}\s*\)|{NAME}\.(?:size\(\)|length\(\)|length))\s*;"))


PLAIN = r"(?:null|nil|false|nullptr|-1|0|\"\"|undefined|(?:Collections|List|Map|Optional)\.(?:empty\w*|of)\(\))"


@rule("SWALLOWED-EXCEPTION-FLOW", (*JAVA, *CPP, *GO))
def _(b: Body) -> Places:
    if b.lang == "go":
        yield from (m.start() for m in b.all(r"\bif\s+err\s*!=\s*nil\s*\{\s*return\s+(?:nil|0|\"\"|false)\s*\}"))
        return
    for at, body in b.handlers:
        if re.fullmatch(rf"\s*return\s+{PLAIN}\s*;\s*", body):
            yield at


@rule("EMPTY-EXCEPT", (*JAVA, *JS, *CPP, *CSHARP))
def _(b: Body) -> Places:
    return (at for at, body in b.handlers if not body.strip())


@rule("EMPTY-EXCEPT", GO)
def _(b: Body) -> Places:
    return (m.start() for m in b.all(r"\bif\s+err\s*!=\s*nil\s*\{\s*\}"))


@rule("LOG-ONLY-EXCEPT", (*JAVA, *JS, *CPP))
def _(b: Body) -> Places:
    for at, body in b.handlers:
        parts = [p.strip() for p in body.split(";") if p.strip()]
        if parts and all(re.match(rf"(?:this\.)?{LOG}\s*(?:\.|\(|<<|::)|\w+\.printStackTrace", p) for p in parts):
            yield at


rule("STATIC-MUTABLE-SHARED-STATE", JAVA, "class")(there(r"^[ \t]*(?:(?:public|private|protected|volatile)\s+)*static\s+(?:(?:public|private|protected|volatile)\s+)*(?!final\b|class\b|interface\b|enum\b|void\b|synchronized\b)[\w.<>\[\], ?]+\s+\w+\s*(?:=[^;{]*)?;|^[ \t]*(?:\w+\s+)*static\s+final\s+[^=;(]*=\s*new\s+(?:ArrayList|LinkedList|HashMap|HashSet|LinkedHashMap|TreeMap)\b"))


@rule("UNUSED-VARIABLE", (*JAVA, *CPP, *JS, *GO))
def _(b: Body) -> Places:
    kind = {"java": r"(?:final\s+)?(?:int|long|double|float|boolean|char|byte|short|var|[A-Z][\w.]*(?:<[^;=()]*>)?)(?:\[\])*\s+", "go": r"(?:var\s+)?", "javascript": r"(?:const|let|var)\s+", "typescript": r"(?:const|let|var)\s+"}.get(b.lang, r"(?:const\s+)?(?:int|long|double|float|bool|char|auto|size_t|std::\w+(?:<[^;=()]*>)?)\s*[*&]?\s+")
    sets = r"\s*:=" if b.lang == "go" else r"(?:\s*:\s*[\w<>\[\]]+)?\s*=(?!=)"
    for m in b.all(rf"(?:^|[;{{}}])[ \t]*{kind}({NAME}){sets}", re.M):
        if m[1] != "_" and len(re.findall(rf"(?<![\w$]){re.escape(m[1])}(?![\w$])", b.text)) == 1:
            yield m.start(1)


@rule("SELF-ASSIGNMENT", (*JAVA, *CPP, *JS, *GO))
def _(b: Body) -> Places:
    return (m.start(1) for m in b.all(r"(?:^|[;{}])[ \t]*([A-Za-z_][\w.]*(?:->\w+)*)\s*=\s*\1[ \t]*(?:;|$)", re.M))


@rule("INFINITE-RECURSION-RISK", ALL)
def _(b: Body) -> Places:
    if b.has(r"\b(?:if|switch|for|while|case|try|select)\b|\?|&&|\|\|"):
        return ()
    return (0 for m in list(b.all(rf"(?<![\w.])(?:this\s*\.\s*|self\s*\.\s*)?{re.escape(b.name)}\s*\("))[:1])


@rule("INFINITE-LOOP-RISK", ALL)
def _(b: Body) -> Places:
    for at, head, body in b.loops:
        endless = re.fullmatch(r"\s*\(\s*(?:true|1|;\s*;)\s*\)\s*", head) or (b.lang == "go" and not head.strip())
        if endless and not re.search(r"\b(?:break|return|throw|panic|exit|goto|await|os\.Exit|System\.exit|select)\b|<-", body):
            yield at


@rule("UNREACHABLE-CODE", (*JAVA, *JS, *CPP))
def _(b: Body) -> Places:
    return (m.start(1) for m in b.all(r"(?<=[;{}])\s*(?:return\b[^;{}]*|throw\b[^;{}]*|break|continue)\s*;\s*(?!case\b|default\b|else\b|catch\b|while\b)([^\s}])"))


@rule("UNREACHABLE-CODE", GO)
def _(b: Body) -> Places:
    return (m.start(1) for m in b.all(r"^[ \t]*(?:return\b[^\n]*[^,({|&+\n]|return|break|continue|panic\([^\n]*\))[ \t]*\n\s*(?!case\b|default\b|\w+:\s*$)([^\s}])", re.M))


@rule("JAVA-STRING-EQ-OPERATOR", JAVA)
def _(b: Body) -> Places:
    yield from (m.start() for m in b.all(r"[\w)]\s*[!=]=\s*\"[^\"\n]*\"|\"[^\"\n]*\"\s*[!=]=\s*(?!null)\w"))
    strings = {m[1] for m in re.finditer(rf"\bString\s+({NAME})\b(?!\s*\()", b.text)}
    yield from (m.start() for m in b.all(rf"(?<![\w.])({NAME})\s*[!=]=\s*({NAME})(?![\w.(])") if m[1] in strings and m[2] in strings)


@rule("FOREACH-COLLECTION-MUTATE", (*JAVA, *CSHARP))
def _(b: Body) -> Places:
    for at, head, body in b.loops:
        over = re.search(rf"(?::|\bin)\s*({NAME})(?:\.(?:keySet|values|entrySet|Keys|Values)(?:\(\))?)?\s*\)", head)
        if over and re.search(rf"(?<![\w.]){over[1]}\.(?i:remove|add|put|clear|removeAt|insert)\s*\(", body) and "break" not in body:
            yield at


@rule("GO-RANGE-LOOP-VAR-ADDR", GO)
def _(b: Body) -> Places:
    for at, head, body in b.loops:
        var = re.match(rf"\s*{NAME}\s*,\s*({NAME})\s*:=\s*range\b", head)
        if var and re.search(rf"&{var[1]}\b(?!\.)", body) and not re.search(rf"\b{var[1]}\s*:=\s*{var[1]}\b", body):
            yield at


@rule("GO-CHANNEL-SEND-AFTER-CLOSE", GO)
def _(b: Body) -> Places:
    for m in b.all(rf"^[ \t]*close\(\s*({NAME})\s*\)", re.M):
        if late := re.search(rf"\b{m[1]}\s*<-", b.text[m.end() :]):
            yield m.end() + late.start()


def _freed(b: Body) -> Iterator[tuple[str, int, str]]:
    """Name, place and what follows each release of a pointer, up to where the name is set anew."""
    for m in b.all(rf"\bfree\s*\(\s*({NAME})\s*\)\s*;|\bdelete\s*(?:\[\s*\]\s*)?({NAME})\s*;"):
        name = m[1] or m[2]
        yield name, m.end(), re.split(rf"(?<![\w>.*]){name}\s*=[^=]|\breturn\b(?![^;]*\b{name}\b)", b.text[m.end() :])[0]


@rule("CPP-USE-AFTER-FREE", CPP)
def _(b: Body) -> Places:
    for name, at, rest in _freed(b):
        if use := re.search(rf"(?<![\w.]){name}\s*(?:->|\[|\.\w)|\*\s*{name}\b|[(,]\s*{name}\s*[,)]", re.sub(rf"\bfree\s*\(\s*{name}\s*\)", "", rest)):
            yield at + use.start()


@rule("CPP-DOUBLE-FREE", CPP)
def _(b: Body) -> Places:
    for name, at, rest in _freed(b):
        if again := re.search(rf"\bfree\s*\(\s*{name}\s*\)|\bdelete\s*(?:\[\s*\]\s*)?{name}\s*;", rest):
            yield at + again.start()


@rule("CPP-DELETE-MISMATCH", CPP)
def _(b: Body) -> Places:
    for m in b.all(rf"({NAME})\s*=\s*new\s+[\w:<>]+\s*(\[)?"):
        wrong = rf"\bdelete\s+{m[1]}\s*;" if m[2] else rf"\bdelete\s*\[\s*\]\s*{m[1]}\s*;"
        if bad := re.search(wrong, b.text[m.end() :]):
            yield m.end() + bad.start()


@rule("JAVA-HASHCODE-EQUALS-MISMATCH", JAVA, "class")
def _(b: Body) -> Places:
    return (0,) if b.has(r"\bboolean\s+equals\s*\(\s*(?:final\s+)?Object\b") != b.has(r"\bint\s+hashCode\s*\(\s*\)") else ()


@rule("JAVA-EQUALS-ON-ARRAY", JAVA)
def _(b: Body) -> Places:
    arrays = {m[1] or m[2] for m in re.finditer(rf"\w\s*\[\s*\]\s*({NAME})\b|\b{NAME}\s+({NAME})\s*\[\s*\]", b.text)}
    return (m.start() for m in b.all(rf"(?<![\w.])({NAME})\.equals\s*\(") if m[1] in arrays)


@rule("JAVA-INTEGER-BOXING-EQ", JAVA)
def _(b: Body) -> Places:
    boxed = {m[1] for m in re.finditer(rf"\b(?:Integer|Long|Short|Byte|Double|Float|Character)\s+({NAME})\b", b.text)}
    return (m.start() for m in b.all(rf"(?<![\w.])({NAME})\s*[!=]=\s*({NAME})(?![\w.(])") if m[1] in boxed and m[2] in boxed)


@rule("GO-NIL-MAP-WRITE", GO)
def _(b: Body) -> Places:
    for m in b.all(rf"\bvar\s+({NAME})\s+map\[[^\]]+\][^\n={{]*$", re.M):
        rest = re.split(rf"\b{m[1]}\s*=\s*[^=]", b.text[m.end() :])[0]
        if write := re.search(rf"(?<![\w.]){m[1]}\[[^\]]*\]\s*(?:=[^=]|\+\+|\+=)", rest):
            yield m.end() + write.start()


rule("EXECUTOR-NOT-SHUTDOWN", JAVA, "class")(there(r"\bExecutors\s*\.\s*new\w+\s*\(|\bnew\s+(?:Scheduled)?ThreadPoolExecutor\s*\(", unless=r"\.\s*(?:shutdown(?:Now)?|close)\s*\("))
rule("MISSING-TIMEZONE", JAVA, "class")(there(r"\bnew\s+SimpleDateFormat\s*\(", unless=r"\.\s*setTimeZone\s*\("))


@rule("SWITCH-NO-DEFAULT", JAVA)
def _(b: Body) -> Places:
    for m in b.all(r"\bswitch\s*\([^{}]*\)\s*\{"):
        if not re.search(r"\bdefault\b", _balanced(b.text, m.end() - 1)):
            yield m.start()


@rule("LIKE-PATTERN-ESCAPE", JAVA)
def _(b: Body) -> Places:
    if not b.has(r"(?i)\blike\b"):
        return ()
    percent, low, slash = (b.has(rf"\.replace(?:All)?\(\s*[\"']{c}") for c in ("%", "_", r"\\\\"))
    joined = [m.start() for m in b.all(r"[\"']%[\"']\s*\+\s*\w+|\+\s*[\"']%[\"']")]
    return joined[:1] if not (percent and low and slash) else ()


@rule("UTF8-BYTE-TRUNCATE", JAVA)
def _(b: Body) -> Places:
    for m in b.all(rf"({NAME})\s*=\s*Arrays\.copyOf(?:Range)?\s*\(\s*\w*[bB]yte\w*"):
        if b.has(rf"new\s+String\s*\(\s*{m[1]}\b"):
            yield m.start()


@rule("INTEGER-MULT-OVERFLOW", JAVA)
def _(b: Body) -> Places:
    ints = {m[1] for m in re.finditer(rf"\bint\s+({NAME})\b", b.text)}
    for m in b.all(rf"\blong\s+{NAME}\s*=\s*({NAME})\s*\*\s*({NAME})\s*(?:\*\s*({NAME})\s*)?;|\breturn\s+({NAME})\s*\*\s*({NAME})\s*;"):
        parts = [x for x in m.groups() if x]
        if all(x in ints for x in parts) and (m[1] or re.search(r"\blong\b", b.head)):
            yield m.start()


@rule("EQUALS-INCOMPLETE-FIELDS", JAVA, "class")
def _(b: Body) -> Places:
    own = re.search(r"\bboolean\s+equals\s*\(\s*(?:final\s+)?Object\b[^{]*\{", b.text)
    if not own:
        return ()
    body = _balanced(b.text, own.end() - 1)
    fields = re.findall(rf"^[ \t]*(?:private|protected)\s+(?!static)(?:final\s+)?[\w.<>\[\], ?]+\s+({NAME})\s*(?:=[^;(]*)?;", b.text, re.M)
    return (own.start(),) if len(fields) > 1 and any(not re.search(rf"\b{f}\b", body) for f in fields) and re.search(r"==|equals", body) else ()


NOTHING = r"\breturn\s+null\s*;"
rule("RESULT-RETURN-NULL", JAVA)(there(NOTHING, head=r"\b(?:Result|Response|ApiResponse|ResponseEntity|Optional|Either)\b\s*(?:<[^(]*>)?\s+\w+\s*\("))


@rule("NEGATIVE-QUANTITY-RETURN", JAVA)
def _(b: Body) -> Places:
    if not re.search(r"(?i)quantity|stock|remain|available|balance|inventory|left", b.name) or b.has(r"Math\.max|[<>]=?\s*\w|requireNonNegative"):
        return ()
    return (m.start() for m in b.all(r"\breturn\s+[\w.]+(?:\(\))?\s*-\s*[\w.]+(?:\(\))?\s*;"))


@rule("DIVISION-BY-COLLECTION-SIZE", JAVA)
def _(b: Body) -> Places:
    for m in b.all(rf"/\s*(?:\(\w+\)\s*)?({NAME})\.(?:size\(\)|length\b)"):
        if not b.has(rf"{m[1]}\.isEmpty\(|{m[1]}\.(?:size\(\)|length)\s*(?:[=!]=|[<>]=?)\s*\d|isEmpty\(\s*{m[1]}\b"):
            yield m.start()


@rule("GROWTH-RATE-DIVIDE-BY-ZERO", JAVA)
def _(b: Body) -> Places:
    if not re.search(r"(?i)growth|rate|ratio|percent|change|yoy|mom", b.name):
        return
    for m in b.all(rf"/\s*(?:\(\w+\)\s*)?({NAME})\b(?![.(])"):
        if m[1] in b.params and not b.has(rf"\b{m[1]}\s*(?:[=!]=|[<>]=?)\s*0|signum"):
            yield m.start()


@rule("INT-ACCUMULATE-LONG", JAVA)
def _(b: Body) -> Places:
    longs = {m[1] for m in re.finditer(rf"\b[lL]ong\s+({NAME})\b", b.text)}
    for m in b.all(rf"\bint\s+({NAME})\s*=\s*0\s*;"):
        for add in re.finditer(rf"\b{m[1]}\s*\+=\s*([^;]+);", b.text[m.end() :]):
            if re.search(r"\bgetLong|longValue|\(long\)|Long\.parse", add[1]) or set(re.findall(NAME, add[1])) & longs:
                yield m.end() + add.start()


rule("CHAINED-GETTER-DEREF", JAVA)(there(rf"\b{NAME}(?:\.get[A-Z]\w*\(\s*\)){{2,}}\.\w+\(", unless=r"Optional|[!=]=\s*null|requireNonNull"))


@rule("RESULT-OK-NULLABLE", JAVA)
def _(b: Body) -> Places:
    ok = r"\b(?:Result|Response|ApiResponse|ResponseEntity)\s*\.\s*(?:ok|success|of)\s*\(\s*"
    yield from (m.start() for m in b.all(ok + r"\w+\.(?:get|find\w*|selectOne|selectById)\s*\("))
    for _, name in declared(b, r"\w+\.(?:get|find\w*|select(?:One|ById))\s*\("):
        if not b.tests(name):
            yield from (m.start() for m in b.all(rf"{ok}{name}\s*\)"))


@rule("NULLABLE-VALUE-USE", JAVA)
def _(b: Body) -> Places:
    names = set(re.findall(rf"@Nullable\s+(?:final\s+)?[\w.<>]+\s+({NAME})", b.head)) | {n for _, n in declared(b, r"\w+\.(?:getIfPresent|getOrNull|findOrNull|orElse\(\s*null|selectOne|queryForObject)\b")}
    for name in names:
        use = re.search(rf"(?<![\w.]){name}\.\w", b.inner)
        if use and not b.tests(name):
            yield b._offset + use.start()


@rule("EMPTY-LOOP-BODY", JAVA)
def _(b: Body) -> Places:
    yield from (at for at, _, body in b.loops if not body.strip())
    yield from (m.start() for m in b.all(r"\bfor\s*\([^;{}]*;[^;{}]*;[^{}()]*(?:\([^{}()]*\)[^{}()]*)*\)\s*;"))


rule("LOOP-ROW-DML", JAVA)(in_loop(rf"\b\w*{STORE}\w*\s*\.\s*(?:insert|update|delete|save|persist|merge|remove|executeUpdate)\w*\s*\(", unless=r"addBatch|Batch\("))
rule("LOOP-NEW-THREAD", JAVA)(in_loop(r"\bnew\s+Thread\s*\("))
rule("FACTORY-RETURN-NULL", JAVA)(lambda b: (m.start() for m in b.all(NOTHING)) if re.match(r"(?:create|make|build|new|of|from|getInstance|forType|parser?For)(?![a-z])", b.name) else ())
rule("N-PLUS-ONE-QUERY", JAVA)(in_loop(rf"\b\w*{STORE}\w*\s*\.\s*(?:find|get|select|query|load|fetch|count|exists)\w*\s*\("))
rule("NON-THREAD-SAFE-SUBSCRIBER-LIST", JAVA, "class")(there(r"\b(?:List|Set|Collection|ArrayList|HashSet)\s*<[^>]*(?i:listener|subscriber|observer|handler|callback|consumer)[^;]*>\s*\w+\s*=\s*new\s+(?:ArrayList|LinkedList|HashSet)\b", unless=r"synchronized|CopyOnWrite|\.lock\("))


@rule("NON-ATOMIC-FIELD-ACCUMULATE", JAVA, "class")
def _(b: Body) -> Places:
    if not b.has(r"\bThread\b|Executor|Runnable|Concurrent|@(?:Service|Component|RestController|Controller|Async|Scheduled)\b|\bvolatile\b") or b.has(r"\bsynchronized\b|\.lock\("):
        return
    for name in re.findall(rf"^[ \t]*private\s+(?:volatile\s+|static\s+)*(?:int|long|double|float)\s+({NAME})\s*(?:=[^;]*)?;", b.text, re.M):
        yield from (m.start() for m in list(b.all(rf"(?<![\w.])(?:this\.)?{name}\s*(?:\+\+|\+=|--|-=)|\+\+(?:this\.)?{name}\b"))[:1])


rule("FOR-UPDATE-NO-NOWAIT", JAVA)(lambda b: (m.start() for m in b.all(r"(?i)\bfor\s+update\b(?!\s+(?:nowait|skip|of\s+\w+\s+nowait))")))


@rule("DEAD-LETTER-QUEUE-NEVER-CONSUMED", JAVA, "class")
def _(b: Body) -> Places:
    for name in set(re.findall(r"\b(\w*(?i:dead_?letter|dlq)\w*)\s*\.\s*(?:add|offer|put|push|send|publish)\s*\(", b.text)):
        if not b.has(rf"\b{name}\s*\.\s*(?:poll|take|remove|peek|drainTo|forEach|iterator|stream|subscribe|receive)\b|:\s*{name}\s*\)"):
            yield next(re.finditer(rf"\b{name}\b", b.text)).start()


@rule("RECURSION-NO-BOUNDARY-GUARD", JAVA)
def _(b: Body) -> Places:
    again = [m.start() for m in b.all(rf"(?<![\w.])(?:this\.)?{re.escape(b.name)}\s*\(")]
    guarded = b.has(r"(?i)\b\w*(?:depth|level|visited|seen|max|limit|remaining)\w*\b")
    return again[:1] if again and b.has(r"\b(?:if|for|while|switch)\b") and not guarded else ()


@rule("PUBLISH-BEFORE-PERSIST", JAVA)
def _(b: Body) -> Places:
    send = re.search(r"\.\s*(?:publish|publishEvent|send|emit|convertAndSend)\s*\(", b.inner)
    if send and re.search(rf"\b\w*{STORE}\w*\s*\.\s*(?:save|insert|persist|update|merge)\w*\s*\(", b.inner[send.end() :]):
        yield b._offset + send.start()


@rule("BATCH-FAILURE-SWALLOWED", JAVA)
def _(b: Body) -> Places:
    for at, _, body in b.loops:
        for m in re.finditer(r"\bcatch\b[^{}]*\{", body):
            inside = _balanced(body, m.end() - 1)
            if not re.search(r"\bthrow\b|\breturn\b|(?i:fail|error|retr|dead|skipped)\w*\s*\.\s*(?:add|put|offer|increment|send)|\+\+", inside):
                yield at


rule("CROSS-JOIN-SELF-ON", JAVA)(there(r"(?i)\bjoin\s+\w+(?:\s+(?:as\s+)?\w+)?\s+on\s+(\w+\.\w+)\s*=\s*\1\b"))
rule("GETTER-SPAWNS-THREAD", JAVA)(lambda b: (m.start() for m in b.all(r"\bnew\s+Thread\s*\(|\bExecutors\s*\.|\b(?:CompletableFuture\.)?(?:runAsync|supplyAsync)\s*\(|\.submit\s*\(")) if re.match(r"get[A-Z]", b.name) else ())
rule("BROADCAST-ROW-SEND", JAVA)(in_loop(r"\.\s*(?:send|push|write|emit|sendMessage)\w*\s*\(", head=r"(?i)\b\w*(?:broadcast|notifyAll|pushToAll|sendToAll|fanOut)\w*\s*\("))


@rule("CACHE-GET-OR-LOAD-NO-LOCK", JAVA)
def _(b: Body) -> Places:
    if b.has(r"synchronized|computeIfAbsent|\.lock\(|putIfAbsent|LoadingCache"):
        return
    for m in b.all(rf"({NAME})\s*=\s*(\w*(?i:cache)\w*)\.get\w*\s*\("):
        if re.search(rf"\b{m[1]}\s*==\s*null", b.text[m.end() :]) and re.search(rf"\b{m[2]}\.put\w*\s*\(", b.text[m.end() :]):
            yield m.start()


rule("RATE-LIMIT-TOCTOU", JAVA)(there(rf"\bif\s*\(\s*({NAME})\.(?:get|intValue)\(\s*\)\s*(?:>=?|<=?)\s*[\w.]+\s*\)[^;]*\{{?[^}}]*\b\1\.(?:decrementAndGet|getAndDecrement|incrementAndGet|getAndIncrement|set|addAndGet)\(", unless=r"synchronized|compareAndSet|\.lock\("))
rule("LOOP-LOCK-NO-SORT", JAVA)(in_loop(r"\.\s*lock\s*\(\s*\)|\bsynchronized\s*\(", unless=r"(?i)\bsort|TreeSet|TreeMap|comparator|compareTo"))


@rule("CACHE-NO-CLEANUP", JAVA, "class")
def _(b: Body) -> Places:
    timed = re.search(r"(?i)\b\w*(?:ttl|expir|expiresAt|timestamp)\w*", b.text)
    kept = re.search(r"\bMap\s*<[^;=]*>\s*(\w*(?i:cache|store|entries)\w*)\s*=", b.text)
    return (kept.start(),) if timed and kept and b.has(r"\.put\s*\(") and not b.has(r"(?i)evict|cleanup|removeIf|schedule|purge|Caffeine|CacheBuilder|\.remove\s*\(") else ()


@rule("WINDOW-FLUSH-DOUBLE-COUNT", JAVA)
def _(b: Body) -> Places:
    if not re.search(r"(?i)flush|window|drain|rotate|roll", b.name) or b.has(r"synchronized|\.lock\(|getAndSet|compute"):
        return ()
    return (m.start() for m in b.all(rf"\b({NAME})\.(?:get|values|entrySet|sum|size)\([^;]*\)(?=[\s\S]*\b\1\.(?:remove|clear|reset)\()|\b({NAME})\.(?:remove|clear|reset)\([^;]*\)\s*;(?=[\s\S]*\b\2\.(?:get|sum|values)\()"))


@rule("CONSTANT-RETURN-IN-GUARD", JAVA)
def _(b: Body) -> Places:
    guard = re.match(r"(?:is|has|can|check|validate|verify|allow|authori[sz]e|permit|should)(?![a-z])", b.name) and re.search(r"\bboolean\b", b.head)
    return (0,) if guard and re.fullmatch(r"\s*return\s+(?:true|false)\s*;\s*\}?\s*", b.inner) else ()


rule("INSECURE-STRING-HASH", JAVA)(lambda b: (m.start() for m in b.all(r"\.\s*hashCode\s*\(\s*\)")) if re.search(r"(?i)password|token|sign|auth|secret|digest|credential|checksum|nonce", b.head + b.inner[:0] + b.name) else ())
rule("NULL-BRANCH-RETURN-OK", JAVA)(there(r"\bif\s*\(\s*\w+\s*==\s*null\s*\)\s*\{?\s*return\s+\w*(?:Result|Response|ResponseEntity)\s*\.\s*(?:ok|success)\s*\("))
rule("SAFE-METHOD-RETURNS-NULLABLE", JAVA)(lambda b: (m.start() for m in b.all(NOTHING + r"|\breturn\s+\w+\.get\s*\([^;]*\)\s*;")) if re.search(r"^safe|Safe(?:ly)?$|OrDefault$|OrEmpty$", b.name) else ())
rule("CSV-INJECTION", JAVA)(lambda b: list(m.start() for m in b.all(r"\.(?:append|write|print|println)\s*\([^;]*\w+\s*(?:\([^)]*\))?\s*(?:\+\s*[\"'][,;][\"']|\)\s*\.append\s*\(\s*[\"'][,;][\"'])"))[:1] if re.search(r"(?i)csv", b.name + b.owner) and not b.has(r"(?i)escape|sanitiz|quote|startsWith\(\s*\"[=+@-]") else ())
rule("QUANTITY-ADD-OVERFLOW", JAVA)(there(r"\bint\s+\w*\s*=\s*\w*(?i:quantity|qty|count|stock)\w*(?:\(\))?\s*\+\s*\w*(?i:quantity|qty|count|stock|delta)\w*(?:\(\))?\s*;|\breturn\s+\w*(?i:quantity|qty|stock)\w*\s*\+\s*\w+\s*;", unless=r"addExact|\blong\b|MAX_VALUE"))

# security, performance and the like
rule("SQL-INJECTION-RISK", (*JAVA, *CSHARP, *GO, *JS))(lambda b: (m.start() for _, name in declared(b, r"[\"'`]\s*(?i:select|insert|update|delete)\b[^;\n]*[\"'`]\s*\+\s*\w") for m in b.all(rf"\.\s*(?:execute\w*|[qQ]uery\w*|Exec\w*|prepareStatement|createQuery|createNativeQuery)\s*\(\s*{name}\s*[,)]")))
rule("COMMAND-INJECTION-RISK", (*JAVA, *GO, *JS))(lambda b: (m.start(1) for m in b.all(rf"\b(?:Runtime\.getRuntime\(\)\.exec|exec|execSync|ProcessBuilder)\s*\(\s*({NAME})\s*[,)]") if m[1] in b.params))
rule("PATH-TRAVERSAL-RISK", (*JAVA, *GO, *JS))(lambda b: (m.start() for m in b.all(rf"\bnew\s+(?:File|FileInputStream|FileReader)\s*\([^)]*?({NAME})\s*\)|\b(?:Paths\.get|fs\.readFile\w*|os\.Open|ioutil\.ReadFile|os\.ReadFile)\s*\([^)]*?({NAME})\s*[,)]") if {m[1], m[2]} & b.params and re.search(r"(?i)@RequestParam|@PathVariable|req|input|user", b.head) and not b.has(r"(?i)normalize|getCanonicalPath|basename|filepath\.Clean|startsWith")))
rule("HTTP-NO-TIMEOUT", JAVA)(there(r"\bnew\s+(?:RestTemplate|OkHttpClient)\s*\(\s*\)|\bHttpClient\s*\.\s*newHttpClient\s*\(|\bopenConnection\s*\(", unless=r"(?i)timeout"))
rule("HTTP-NO-TIMEOUT", GO)(there(r"\bhttp\s*\.\s*(?:Get|Post|PostForm|Head)\s*\(|&?http\.Client\s*\{\s*\}", unless=r"Timeout|WithDeadline"))
rule("HTTP-NO-TIMEOUT", JS)(there(r"\b(?:axios(?:\.\w+)?|fetch|got|request)\s*\(", unless=r"(?i)timeout|signal|abort"))
rule("HTTP-NO-TIMEOUT", CSHARP)(there(r"\bnew\s+HttpClient\s*\(\s*\)", unless=r"Timeout"))
rule("BUSY-WAIT", (*JAVA, *CPP))(lambda b: [at for at, head, body in b.loops if not body.strip() and not re.search(r";|:|\brange\b", head)] + [m.start() for m in b.all(r"\bwhile\s*\([^{};]*\)\s*;") if "do" not in b.text[max(0, m.start() - 4) : m.start()] and not re.search(r"\}\s*$", b.text[: m.start()])])
rule("BUSY-WAIT", GO)(lambda b: (at for at, head, body in b.loops if not body.strip() and "range" not in head))
rule("RETRY-WITHOUT-BACKOFF", (*JAVA, *JS))(lambda b: (at for at, head, body in b.loops if re.search(r"\btry\b", body) and re.search(r"\bcatch\b", body) and (re.search(r"(?i)retr|attempt|tries", head + body) or re.search(r"\btrue\b", head)) and not re.search(r"(?i)sleep|delay|backoff|setTimeout|await\s+new\s+Promise|wait\(", body)))
rule("BLOCKING-CALL-IN-ASYNC", JS)(there(r"\b\w+Sync\s*\(|\bAtomics\.wait\s*\(", head=r"\basync\b"))
rule("BLOCKING-CALL-IN-ASYNC", CSHARP)(there(r"\.\s*(?:Result\b|Wait\s*\(\s*\)|GetAwaiter\(\)\.GetResult\(\))|\bThread\.Sleep\s*\(", head=r"\basync\b"))
rule("UNBOUNDED-GOROUTINE", GO)(in_loop(r"^\s*go\s+\w|\bgo\s+func\b", unless=r"(?i)sem(?:aphore)?\b|errgroup|SetLimit|workerpool|WaitGroup|make\(chan [^)]*,\s*\w+\)"))


@rule("MUTEX-LOCK-NO-UNLOCK", (*GO, *CPP))
def _(b: Body) -> Places:
    for m in b.all(r"\b([A-Za-z_][\w.>-]*?)(?:\.|->)(R?[Ll]ock)\s*\(\s*\)"):
        unlock = m[2].replace("Lock", "Unlock") if "Lock" in m[2] else "unlock"
        if not b.has(rf"{re.escape(m[1])}(?:\.|->){unlock}\s*\("):
            yield m.start()


rule("SQL-IN-LOOP", (*JAVA, *GO, *JS))(in_loop(rf"\b\w*{STORE}\w*\s*\.\s*(?:query\w*|Query\w*|exec\w*|Exec\w*|prepareStatement|createStatement)\s*\(", unless=r"addBatch|executeBatch"))
rule("TRANSACTION-SCOPE-TOO-LARGE", JAVA)(there(REMOTE, head=r"@Transactional\b"))
rule("MISSING-PAGINATION", JAVA)(there(r"\.\s*(?:findAll|selectAll|listAll|getAll)\s*\(\s*\)", unless=r"(?i)pageable|pagerequest|limit|offset", head=r"@(?:GetMapping|RequestMapping|GET)\b"))
rule("MISSING-PAGINATION", (*JS, *GO))(there(r"(?:\.\s*(?:findAll|find)\s*\(\s*(?:\{\s*\})?\s*\)|\.Find\(\s*&\w+\s*\))", unless=r"(?i)limit|skip|offset|page", head=r"(?i)\b(?:req|ctx|context|w\s+http)\b"))


def bodies(text: str, lang: str) -> Iterator[Body]:
    """Functions and classes, each from its head (annotations are part of it) to its closing brace."""
    plain = without_comments(text)
    for kind, name, owner, *_, first, last in brace_spans(text):
        yield Body(kind, name, owner, lang, plain.count("\n", 0, first) + 1, plain[first:last])


def hits(text: str, lang: str) -> list[tuple[str, int, int]]:
    """Each rule's hits, ``rule, first line, last line``, by line. A rule that holds in a function and in one around it counts there once."""
    found = set()
    for b in bodies(text, lang):
        for name, kind, languages, find in RULES:
            if kind == b.kind and lang in languages:
                for at in find(b):
                    line = b.start + b.text.count("\n", 0, at) if at else _head_line(b)
                    found.add((name, line, line))
    return sorted(found, key=lambda h: (h[1], h[0]))


def _head_line(b: Body) -> int:
    """The line of a block's own head, below its annotations."""
    skipped = 0
    for line in b.text.split("\n"):
        if not line.strip().startswith("@"):
            break
        skipped += 1
    return b.start + skipped
