"""Rules that Python's own syntax tree decides, and the flow of untrusted values within a function.

Nothing here recurses into the tree, so that a text nested thousands of levels
deep is read like any other; one that the parser itself refuses is reported as a
SYNTAX-ERROR.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.Lambda, ast.ClassDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
BRANCHES = (ast.If, ast.IfExp, *LOOPS)
HANDLED = (ast.Try, ast.TryStar)


def parse(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def below(node: ast.AST, into: Callable[[ast.AST], bool] = lambda n: not isinstance(n, SCOPES)) -> Iterator[ast.AST]:
    """All nodes below one, in the order of the text; what is below a scope of its own is left out."""
    todo = list(ast.iter_child_nodes(node))[::-1]
    while todo:
        one = todo.pop()
        yield one
        if into(one):
            todo.extend(list(ast.iter_child_nodes(one))[::-1])


def within(body: Iterable[ast.AST]) -> Iterator[ast.AST]:
    """The statements of a block and all below them."""
    for one in body:
        yield one
        if not isinstance(one, SCOPES):
            yield from below(one)


def name_of(node: ast.AST | None) -> str:
    """Source of an expression; empty where there is none, or it is nested too deeply to be a name."""
    try:
        return ast.unparse(node) if node is not None else ""
    except (ValueError, RecursionError):
        return ""


def dotted(node: ast.AST | None) -> str:
    """``a.b.c`` of names and attributes; empty for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


def calls(node: ast.AST, pattern: str) -> bool:
    return isinstance(node, ast.Call) and re.fullmatch(pattern, dotted(node.func) or _last(node.func)) is not None


def _last(node: ast.AST) -> str:
    return f"?.{node.attr}" if isinstance(node, ast.Attribute) else ""


def keyword(node: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in node.keywords if k.arg == name), None)


def truth(node: ast.AST | None) -> bool | None:
    return bool(node.value) if isinstance(node, ast.Constant) else None


def targets(node: ast.AST) -> list[ast.AST]:
    if isinstance(node, ast.Assign):
        return node.targets
    return [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign, ast.NamedExpr)) else []


def idle(body: list) -> bool:
    return all(isinstance(s, ast.Pass) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) for s in body)


def names_in(node: ast.AST) -> set[str]:
    return {n.id for n in [node, *below(node, lambda _: True)] if isinstance(n, ast.Name)}


SHELL = r"subprocess\.(run|call|Popen|check_output|check_call)"
HTTP = r"(requests|httpx|session)\.(get|post|put|delete|patch|head|options|request)"
LOGGED = r"(?:\w+\.)*(?:print|log|logger|logging|_logger|_log)(?:\.\w+)?"
OPENED = r"open|io\.open|socket\.socket|sqlite3\.connect|tempfile\.NamedTemporaryFile|urllib\.request\.urlopen"
QUERY = r"(?:[\w?]+\.)*(?:execute|executemany|executescript|raw|query)"
IO = rf"{HTTP}|{SHELL}|{OPENED}|time\.sleep|(?:\w+\.)+(?:recv|send|sendall|connect|execute)|urllib\.request\.urlopen"


def _broad(h: ast.ExceptHandler) -> bool:
    return dotted(h.type) in ("Exception", "BaseException")


def _only_logs(body: list) -> bool:
    return bool(body) and all(isinstance(s, ast.Expr) and calls(s.value, LOGGED) for s in body)


def _exits(body: list) -> bool:
    return any(isinstance(s, (ast.Raise, ast.Return, ast.Continue, ast.Break)) for s in body)


def _loop_ends(loop: ast.While) -> bool:
    """A return, a raise, a yield, an await, or a break of the loop's own."""
    todo = [(s, True) for s in loop.body]
    while todo:
        n, own = todo.pop()
        if isinstance(n, (ast.Return, ast.Raise, ast.Yield, ast.YieldFrom, ast.Await)) or (own and isinstance(n, ast.Break)) or calls(n, r"sys\.exit|exit|os\._exit"):
            return True
        if not isinstance(n, SCOPES):
            todo.extend((c, own and not isinstance(n, LOOPS)) for c in ast.iter_child_nodes(n))
    return False


def _calls_itself_always(f: ast.AST) -> bool:
    """Without a branch or a way out, a function that calls itself never ends."""
    inside = list(below(f))
    return any(calls(n, rf"(?:self\.|cls\.)?{f.name}") for n in inside) and not any(isinstance(n, (*BRANCHES, *HANDLED, ast.BoolOp, ast.Match, ast.Raise, ast.Yield, ast.YieldFrom, ast.comprehension)) for n in inside)


def _mutates(loop: ast.For) -> bool:
    over = loop.iter.func.value if calls(loop.iter, r".*\.(?:keys|values|items)") else loop.iter
    if not (over := dotted(over)):
        return False
    for n in within(loop.body):
        if isinstance(n, ast.Delete) and any(isinstance(t, ast.Subscript) and dotted(t.value) == over for t in n.targets):
            return True
        if calls(n, rf"{re.escape(over)}\.(?:pop|popitem|remove|append|insert|extend|clear|update|add|discard|setdefault)"):
            return True
    return False


def _repeated_keys(node: ast.Dict) -> bool:
    keys = [(type(k.value), k.value) for k in node.keys if isinstance(k, ast.Constant)]
    return len(keys) != len(set(keys))


def _blocks(node: ast.AST) -> Iterator[list]:
    for part in ("body", "orelse", "finalbody"):
        if isinstance(block := getattr(node, part, None), list):
            yield block


def _never_reached(node: ast.AST) -> list[ast.AST]:
    """The statement after one that leaves its block."""
    return [b[i + 1] for b in _blocks(node) for i, s in enumerate(b[:-1]) if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue))]


def _zero_divisor(n: ast.AST) -> bool:
    if not (isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Div, ast.FloorDiv, ast.Mod))):
        return False
    right = n.right
    if isinstance(right, ast.Constant):
        return isinstance(right.value, (int, float)) and right.value == 0
    return calls(right, "len|sum") and not isinstance(n.left, ast.Constant)


def _past_the_end(n: ast.AST) -> bool:
    """``x[len(x)]``, or a literal's element beyond it."""
    if not isinstance(n, ast.Subscript):
        return False
    if calls(n.slice, "len") and n.slice.args:
        return dotted(n.value) != "" and dotted(n.slice.args[0]) == dotted(n.value)
    return isinstance(n.value, (ast.List, ast.Tuple)) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, int) and n.slice.value >= len(n.value.elts)


def _opened_and_dropped(f: ast.AST) -> list[ast.AST]:
    """Assignments of an opened resource that the function neither closes, returns, keeps nor hands on."""
    return [s for s, closed, _ in _opened(f) if not closed]


def _opened(f: ast.AST) -> Iterator[tuple[ast.AST, bool, bool]]:
    """Assignments of opened resources; whether each is closed at all, and in a ``finally`` or ``with``."""
    inside = list(below(f))
    ensured = {id(n) for t in inside if isinstance(t, HANDLED) for n in within(t.finalbody)}
    for s in inside:
        if not (isinstance(s, ast.Assign) and calls(s.value, OPENED) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name)):
            continue
        name = s.targets[0].id
        closing = [n for n in inside if calls(n, rf"{name}\.(?:close|shutdown|__exit__)")]
        managed = any(isinstance(n, (ast.With, ast.AsyncWith)) and any(name in names_in(i.context_expr) for i in n.items) for n in inside)
        leaves = any(isinstance(n, (ast.Return, ast.Yield)) and n.value is not None and name in names_in(n.value) for n in inside)
        handed = any(isinstance(n, ast.Assign) and n is not s and name in names_in(n.value) and not isinstance(n.targets[0], ast.Name) for n in inside)
        handed |= any(isinstance(n, ast.Call) and any(isinstance(a, ast.Name) and a.id == name for a in n.args) and not calls(n, r"json\.\w+|len|list|csv\.\w+") for n in inside)
        yield s, bool(closing) or managed or leaves or handed, managed or leaves or handed or any(id(c) in ensured for c in closing)


def _maybe_none_used(f: ast.AST) -> list[ast.AST]:
    """Attributes of a value that may be None (``get`` of one argument, ``re.match``, ``None`` itself) without a test of its name."""
    inside, out = list(below(f)), []
    tested = {n for t in inside if isinstance(t, (ast.If, ast.IfExp, ast.While, ast.Assert, ast.BoolOp)) for n in names_in(t.test if not isinstance(t, ast.BoolOp) else t)}
    for s in inside:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and s.targets[0].id not in tested:
            v, name = s.value, s.targets[0].id
            maybe = (isinstance(v, ast.Constant) and v.value is None) or calls(v, r"re\.(?:match|search|fullmatch)|(?:\w+\.)*(?:find_one|first|one_or_none)|shutil\.which|os\.environ\.get") and len(v.args) <= 2 or (calls(v, r"(?:\w+\.)+get") and not calls(v, HTTP) and len(v.args) == 1)
            again = any(t is not s and isinstance(t, ast.Assign) and any(isinstance(x, ast.Name) and x.id == name for x in t.targets) for t in inside)
            if maybe and not again:
                out += [n for n in inside if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == name and n.lineno > s.lineno][:1]
    return out


def _unused(f: ast.AST) -> list[ast.AST]:
    """Names that the function assigns and nothing within it reads; ``_`` and names that are global are left out."""
    inside = list(below(f, lambda _: True))
    read = {n.id for n in inside if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Store)}
    outer = {x for n in inside if isinstance(n, (ast.Global, ast.Nonlocal)) for x in n.names}
    if any(calls(n, "locals|vars|eval|exec") for n in inside):
        return []
    first: dict[str, ast.AST] = {}
    for s in below(f):
        if isinstance(s, (ast.Assign, ast.AnnAssign)):
            for t in targets(s):
                if isinstance(t, ast.Name) and not t.id.startswith("_") and t.id not in read | outer and (isinstance(s, ast.Assign) or s.value is not None):
                    first.setdefault(t.id, s)
    return list(first.values())


def _redefined_in_loop(loop: ast.AST) -> list[ast.AST]:
    """Inner loops over the same variable as one around them."""
    own = {n.id for n in [loop.target, *below(loop.target)] if isinstance(n, ast.Name)} if isinstance(loop, (ast.For, ast.AsyncFor)) else set()
    own.discard("_")
    return [n for n in within(loop.body) if isinstance(n, (ast.For, ast.AsyncFor)) and own & {x.id for x in [n.target, *below(n.target)] if isinstance(x, ast.Name)}]


def _no_super_init(c: ast.ClassDef) -> bool:
    if not [b for b in c.bases if dotted(b) not in ("object", "ABC", "abc.ABC", "Protocol", "typing.Protocol", "")]:
        return False
    init = next((f for f in c.body if isinstance(f, FUNCTIONS) and f.name == "__init__"), None)
    return init is not None and not any(isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("__init__", "__post_init__") for n in below(init))


# Misspelt parts of names.
TYPOS = {"adress": "address", "calender": "calendar", "conection": "connection", "defualt": "default", "delimeter": "delimiter", "enviroment": "environment", "lenght": "length", "mesage": "message", "occured": "occurred", "paramter": "parameter", "recieve": "receive", "refered": "referred", "reponse": "response", "retreive": "retrieve", "seperate": "separate", "succesful": "successful", "sucess": "success", "widht": "width"}


def _misspelt(name: str) -> bool:
    parts = re.split(r"_+|(?<=[a-z0-9])(?=[A-Z])", name)
    return any(p.lower() in TYPOS for p in parts)


def _yields_bool(value: ast.AST | None) -> bool | None:
    """Whether a returned value is certainly a truth value, certainly not, or unknown."""
    if isinstance(value, ast.Constant):
        return isinstance(value.value, bool)
    if isinstance(value, (ast.List, ast.Dict, ast.Set, ast.Tuple, ast.JoinedStr, ast.ListComp, ast.DictComp)) or value is None:
        return False
    return None


def _odd_predicate(f: ast.AST) -> bool:
    """``is_``, ``has_``, ``can_`` or ``should_`` that returns something that is no truth value, or nothing at all."""
    if not re.match(r"(is|has|can|should)_", f.name):
        return False
    inside = list(below(f))
    if any(isinstance(n, (ast.Yield, ast.YieldFrom, ast.Raise)) for n in inside) or idle(f.body):
        return False
    returned = [n.value for n in inside if isinstance(n, ast.Return)]
    return not returned or any(_yields_bool(v) is False for v in returned)


def _changes_self(f: ast.AST) -> bool:
    """A ``get_`` method that sets, deletes or appends to an attribute of its object; a cache filled once is no such change."""
    if not re.match(r"get(_|[A-Z])", f.name):
        return False
    for n in below(f):
        for t in [*targets(n), *(n.targets if isinstance(n, ast.Delete) else [])]:
            base = t.value if isinstance(t, ast.Subscript) else t
            if dotted(base).startswith("self.") and "cache" not in dotted(base).lower() and not dotted(base).startswith("self._"):
                return True
        if calls(n, r"self\.(?!_)\w+\.(?:append|add|remove|pop|clear|update|insert)"):
            return True
    return False


def _locked_unsafely(f: ast.AST) -> list[ast.AST]:
    """``x.acquire()`` where no ``finally`` releases x."""
    inside = list(below(f))
    ensured = [n for t in inside if isinstance(t, HANDLED) for n in within(t.finalbody)]
    found = [n for n in inside if isinstance(n, ast.Expr) and calls(n.value, r"(?:\w+\.)*\w*(?i:lock|mutex|sem)\w*\.acquire")]
    return [n for n in found if not any(calls(e, re.escape(dotted(n.value.func.value)) + r"\.release") for e in ensured)]


def _status_unread(f: ast.AST) -> list[ast.AST]:
    """Responses whose body is read though nothing looks at their status."""
    inside, out = list(below(f)), []
    for s in inside:
        if isinstance(s, ast.Assign) and calls(s.value, HTTP) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
            used = {n.attr for n in inside if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == s.targets[0].id}
            if used & {"json", "text", "content"} and not used & {"status_code", "ok", "raise_for_status", "is_success"}:
                out.append(s)
    return out


def _retries_at_once(loop: ast.AST) -> bool:
    """A loop that tries a call again on an exception, without a pause."""
    tries = [n for n in within(loop.body) if isinstance(n, HANDLED)]
    again = any(any(isinstance(s, ast.Continue) for s in within(h.body)) or idle(h.body) or _only_logs(h.body) for t in tries for h in t.handlers)
    counted = isinstance(loop, ast.While) or (calls(loop.iter, "range") and re.search(r"retr|attempt|tries", name_of(loop.target) + name_of(loop.iter), re.I))
    return bool(tries and again and counted and any(calls(n, IO) for t in tries for n in within(t.body))) and not any(calls(n, r"(?:\w+\.)*(?:sleep|wait|backoff)\w*") for n in within(loop.body))


def _locks(w: ast.AST) -> bool:
    return isinstance(w, (ast.With, ast.AsyncWith)) and any(re.search(r"lock|mutex", name_of(i.context_expr), re.I) for i in w.items)


def _opens_transaction(w: ast.AST) -> bool:
    return isinstance(w, (ast.With, ast.AsyncWith)) and any(re.search(r"transaction|atomic|\.begin\(", name_of(i.context_expr), re.I) for i in w.items)


def _unpaged(f: ast.AST) -> bool:
    """A handler of a list route that returns all rows."""
    route = any(re.search(r"\.(?:get|route|api_view)\b", name_of(d)) for d in f.decorator_list)
    every = any(calls(n, r"(?:[\w?]+\.)*(?:all|fetchall|find_all)") for n in below(f))
    paged = re.search(r"\b(?:limit|offset|page|paginat\w*|per_page|page_size|cursor|islice)\b", name_of(f), re.I)
    return route and every and not paged


ASSERTION = r"(?:self\.)?(?:assert\w*|fail\w*|expect\w*|verify\w*)|pytest\.(?:raises|warns|fail)|(?:\w+\.)+assert_\w+"


def _no_assertion(f: ast.AST) -> bool:
    real = [s for s in f.body if not idle([s])]
    return f.name.startswith("test") and len(real) >= 2 and not any(isinstance(n, ast.Assert) or calls(n, ASSERTION) or calls(n, r".*\.(?:raises|warns)") for n in below(f, lambda _: True))


def _swallowed(h: ast.ExceptHandler) -> bool:
    """A handler that goes on with a plain default value, so that the caller never learns."""
    last = h.body[-1] if h.body else None
    return isinstance(last, ast.Return) and (last.value is None or (isinstance(last.value, ast.Constant) and last.value.value in (None, False)) or (isinstance(last.value, (ast.List, ast.Dict)) and not name_of(last.value).strip("[]{}"))) and not any(isinstance(n, ast.Raise) for n in within(h.body))


def _silent(h: ast.ExceptHandler) -> bool:
    """A handler that neither raises, logs nor looks at what it caught."""
    inside = list(within(h.body))
    return not any(isinstance(n, ast.Raise) or calls(n, LOGGED) or calls(n, r"(?:\w+\.)*(?:warn|warning|error|exception|capture_exception)") for n in inside) and (h.name is None or not any(isinstance(n, ast.Name) and n.id == h.name for n in inside))


def _is(*kinds):
    return lambda n: isinstance(n, kinds)


_handler, _function, _loop, _class = _is(ast.ExceptHandler), _is(*FUNCTIONS), _is(*LOOPS), _is(ast.ClassDef)

#: Rules of one node.
NODE_RULES: dict[str, Callable[[ast.AST], bool]] = {
    "EMPTY-EXCEPT": lambda n: _handler(n) and idle(n.body),
    "BARE-EXCEPT": lambda n: _handler(n) and n.type is None,
    "BROAD-EXCEPT": lambda n: _handler(n) and n.type is not None and _broad(n),
    "LOG-ONLY-EXCEPT": lambda n: _handler(n) and _only_logs(n.body),
    "SWALLOWED-EXCEPTION-FLOW": lambda n: _handler(n) and _swallowed(n),
    "EXCEPTION-SWALLOWED-NO-LOG": lambda n: _handler(n) and not idle(n.body) and _silent(n),
    "EXCEPTION-LOST-CONTEXT": lambda n: _handler(n) and any(isinstance(r, ast.Raise) and isinstance(r.exc, ast.Call) and r.cause is None for r in within(n.body)),
    "PRINT-DEBUG": lambda n: calls(n, "print"),
    "ASSERT-USED": _is(ast.Assert),
    "ALWAYS-TRUE-FALSE": lambda n: isinstance(n, (ast.If, ast.IfExp)) and truth(n.test) is not None,
    "EXCEPTION-NOT-RAISED": lambda n: isinstance(n, ast.Expr) and calls(n.value, r"(\w+\.)*[A-Z]\w*(Error|Exception)"),
    "MUTABLE-DEFAULT-ARG": lambda n: _function(n) and any(isinstance(d, (ast.List, ast.Dict, ast.Set)) or calls(d, "list|dict|set|bytearray|collections\\.\\w+") for d in [*n.args.defaults, *n.args.kw_defaults] if d is not None),
    "SUBPROCESS-SHELL-TRUE": lambda n: calls(n, SHELL) and truth(keyword(n, "shell")) is True,
    "SELF-ASSIGNMENT": lambda n: isinstance(n, ast.Assign) and len(n.targets) == 1 and dotted(n.value) != "" and dotted(n.targets[0]) == dotted(n.value),
    "INFINITE-RECURSION-RISK": lambda n: _function(n) and _calls_itself_always(n),
    "INFINITE-LOOP-RISK": lambda n: isinstance(n, ast.While) and truth(n.test) is True and not _loop_ends(n),
    "DICT-ITERATE-MUTATE": lambda n: isinstance(n, ast.For) and _mutates(n),
    "DUPLICATE-DICT-KEY": lambda n: isinstance(n, ast.Dict) and _repeated_keys(n),
    "DIVISION-BY-ZERO-RISK": _zero_divisor,
    "COLLECTION-INDEX-OUT-OF-BOUNDS": _past_the_end,
    "MISSING-SUPER-INIT": lambda n: _class(n) and _no_super_init(n),
    "IDENTIFIER-TYPO": lambda n: (isinstance(n, (*FUNCTIONS, ast.ClassDef)) and _misspelt(n.name)) or (isinstance(n, ast.arg) and _misspelt(n.arg)) or (isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and _misspelt(n.id)),
    "BOOL-PREFIX-NO-BOOL-RETURN": lambda n: _function(n) and _odd_predicate(n),
    "GETTER-HAS-SIDE-EFFECT": lambda n: _function(n) and _changes_self(n),
    "SETTER-RETURNS-VALUE": lambda n: _function(n) and n.name.startswith("set_") and any(isinstance(r, ast.Return) and r.value is not None and name_of(r.value) not in ("None", "self") for r in below(n)),
    "EVAL-USAGE": lambda n: calls(n, "eval|exec"),
    "WEAK-HASH": lambda n: calls(n, r"hashlib\.(md5|sha1)") or (calls(n, r"hashlib\.new") and bool(n.args) and isinstance(n.args[0], ast.Constant) and str(n.args[0].value).lower() in ("md5", "sha1")),
    "UNSAFE-DESERIALIZATION": lambda n: calls(n, r"(?:c?pickle|marshal|dill|shelve)\.(?:loads?|Unpickler|open)|jsonpickle\.decode|yaml\.unsafe_load") or (calls(n, r"yaml\.load(?:_all)?") and "Safe" not in name_of(keyword(n, "Loader") or (n.args[1] if len(n.args) > 1 else None))),
    "HTTP-NO-TIMEOUT": lambda n: calls(n, HTTP) and dotted(n.func).startswith(("requests", "httpx")) and keyword(n, "timeout") is None,
    "BUSY-WAIT": lambda n: isinstance(n, ast.While) and idle(n.body),
    "RETRY-WITHOUT-BACKOFF": lambda n: _loop(n) and _retries_at_once(n),
    "BLOCKING-CALL-IN-ASYNC": lambda n: isinstance(n, ast.AsyncFunctionDef) and any(calls(c, rf"time\.sleep|requests\.\w+|urllib\.request\.urlopen|{SHELL}") for c in below(n)),
    "IO-IN-LOCK": lambda n: _locks(n) and any(calls(c, IO) for c in within(n.body)),
    "TRANSACTION-SCOPE-TOO-LARGE": lambda n: _opens_transaction(n) and any(calls(c, rf"{HTTP}|{SHELL}|time\.sleep|urllib\.request\.urlopen") for c in within(n.body)),
    "MISSING-PAGINATION": lambda n: _function(n) and _unpaged(n),
    "SQL-IN-LOOP": lambda n: _loop(n) and any(calls(c, QUERY) for c in within(n.body)),
    "TEST-NO-ASSERTION": lambda n: _function(n) and _no_assertion(n),
}
#: Rules that name the nodes at fault within a function or loop.
PART_RULES: dict[str, tuple[Callable[[ast.AST], bool], Callable[[ast.AST], list[ast.AST]]]] = {
    "RESOURCE-LEAK": (_function, _opened_and_dropped),
    "RESOURCE-CLOSE-NOT-GUARANTEED": (_function, lambda f: [s for s, closed, ensured in _opened(f) if closed and not ensured]),
    "POSSIBLE-NONE-DEREF": (_function, _maybe_none_used),
    "UNREACHABLE-CODE": (lambda n: not isinstance(n, ast.Lambda), _never_reached),
    "UNUSED-VARIABLE": (_function, _unused),
    "REDEFINE-IN-LOOP": (_loop, _redefined_in_loop),
    "PYTHON-LOCK-NO-RELEASE": (_function, _locked_unsafely),
    "HTTP-NO-STATUS-CHECK": (_function, _status_unread),
}

#: What an untrusted value must not reach: rule, call, position of the argument.
SINKS = {
    "SQL-INJECTION-RISK": r"(?:[\w?]+\.)*(?:execute|executemany|executescript|raw)",
    "COMMAND-INJECTION-RISK": rf"os\.(?:system|popen)|{SHELL}|commands\.getoutput",
    "PATH-TRAVERSAL-RISK": r"open|io\.open|(?:flask\.)?send_file|os\.(?:remove|unlink|rmdir|listdir)|shutil\.rmtree|pathlib\.Path",
    "SSRF-RISK": rf"{HTTP}|urllib\.request\.urlopen",
}
CLEANED = r"(?:\w+\.)*(?:escape\w*|quote\w*|sanitiz\w*|clean\w*|secure_filename|basename|int|float|bool|len|uuid\.UUID|validate\w*|allowlist\w*|whitelist\w*)"
SOURCE = r"(?:flask\.)?request\.(?:args|form|values|json|data|files|cookies|headers|GET|POST)|input|sys\.argv"


def _trusts(node: ast.AST | None, dirty: set[str]) -> bool:
    """Whether no untrusted value goes into an expression except through a call that cleans it."""
    todo = [node] if node is not None else []
    while todo:
        one = todo.pop()
        if calls(one, CLEANED):
            continue
        if (isinstance(one, ast.Name) and one.id in dirty) or re.match(rf"(?:{SOURCE})(?!\w)", dotted(one)) or calls(one, "input"):
            return False
        todo.extend(ast.iter_child_nodes(one))
    return True


def tainted(f: ast.AST, trust_parameters: bool = False) -> list[tuple[str, ast.AST]]:
    """Rule and call for each untrusted value that reaches a sink in the function.

    Parameters (unless trusted) and requests are untrusted; an assignment passes
    it on, or clears it; after a branch a name is untrusted if it is so after
    either way; loops are read twice.
    """
    a = f.args
    every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]
    found: dict[tuple[str, int], tuple[str, ast.AST]] = {}

    def look(node: ast.AST, dirty: set[str]) -> None:
        for n in [node, *below(node)]:
            for rule, sink in SINKS.items():
                if not calls(n, sink) or not (args := [*n.args[:1], *[k.value for k in n.keywords if k.arg in ("url", "args", "cmd", "file", "path")]]):
                    continue
                value = args[0]
                if rule == "COMMAND-INJECTION-RISK" and calls(n, SHELL) and truth(keyword(n, "shell")) is not True:
                    continue
                if rule == "SSRF-RISK" and calls(n, HTTP) and dotted(n.func).endswith("request") and len(n.args) > 1:
                    value = n.args[1]
                if not _trusts(value, dirty):
                    found[rule, id(n)] = (rule, n)

    start = set() if trust_parameters else {p.arg for p in every if p.arg not in ("self", "cls")}
    _read(f.body, start, look)
    return list(found.values())


def _read(body: list, dirty: set[str], look: Callable[[ast.AST, set[str]], None], level: int = 0) -> set[str]:
    """Names untrusted after a block; blocks nested more than 50 deep are read as if they were flat."""
    for s in body:
        if isinstance(s, SCOPES):
            continue
        inner = [b for b in _blocks(s)] + [h.body for h in getattr(s, "handlers", [])] + [c.body for c in getattr(s, "cases", [])]
        if inner and level < 50:
            for head in (x for x in ast.iter_child_nodes(s) if not isinstance(x, (ast.stmt, ast.ExceptHandler, ast.match_case))):
                look(head, dirty)
            if isinstance(s, (ast.For, ast.AsyncFor)) and not _trusts(s.iter, dirty):
                dirty = dirty | names_in(s.target)
            for item in getattr(s, "items", []):
                if item.optional_vars is not None and not _trusts(item.context_expr, dirty):
                    dirty = dirty | names_in(item.optional_vars)
            after = [_read(b, set(dirty), look, level + 1) for b in inner]
            if isinstance(s, LOOPS):
                after += [_read(s.body, set(after[0]), look, level + 1), dirty]
            if isinstance(s, (ast.Match, *HANDLED)) or (isinstance(s, ast.If) and not s.orelse):
                after.append(dirty)
            dirty = set().union(*after)
            continue
        look(s, dirty)
        value = getattr(s, "value", None)
        for t in targets(s):
            names = {n.id for n in [t, *below(t)] if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
            if not _trusts(value, dirty) or (isinstance(s, ast.AugAssign) and names & dirty):
                dirty = dirty | names
            else:
                dirty = dirty - names
    return dirty


def hits(text: str) -> list[tuple[str, int, int]]:
    """Each rule's hits in Python source, ``rule, first line, last line``, by line; a text that can't be parsed is one SYNTAX-ERROR."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as wrong:
        at = getattr(wrong, "lineno", None) or 1
        return [("SYNTAX-ERROR", at, at)]
    found = set()
    for n in below(tree, lambda _: True):
        if not hasattr(n, "lineno"):
            continue
        found.update((rule, n.lineno, n.end_lineno) for rule, flags in NODE_RULES.items() if flags(n))
        for rule, (kind, parts) in PART_RULES.items():
            if kind(n):
                found.update((rule, p.lineno, p.end_lineno) for p in parts(n))
        if isinstance(n, FUNCTIONS):
            found.update((rule, c.lineno, c.end_lineno) for rule, c in tainted(n))
    return sorted(found, key=lambda h: (h[1], h[0], h[2]))


def complexity(f: ast.AST) -> tuple[int, int, int]:
    """Cyclomatic and cognitive complexity and deepest nesting of a function's own statements.

    A step counts once, and once more in the cognitive measure for each level it
    is nested in. Steps: if, loop, conditional expression; a try's handlers and
    a match's cases, one at least; further operands of and/or; a comprehension's
    loops and conditions.
    """
    paths, load, deepest = 1, 0, 0
    todo = [(c, 0) for c in ast.iter_child_nodes(f)]
    while todo:
        n, level = todo.pop()
        step, deeper = 0, False
        if isinstance(n, BRANCHES):
            step, deeper = 1, not isinstance(n, ast.IfExp)
        elif isinstance(n, HANDLED):
            step, deeper = max(1, len(n.handlers)), True
        elif isinstance(n, ast.Match):
            step, deeper = max(1, len(n.cases)), True
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            deeper = True
        elif isinstance(n, ast.BoolOp):
            step = len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            step = 1 + len(n.ifs)
        paths, load, deepest = paths + step, load + step * (1 + level), max(deepest, level + deeper)
        if not isinstance(n, (*FUNCTIONS, ast.ClassDef)):
            todo.extend((c, level + deeper) for c in ast.iter_child_nodes(n))
    return paths, load, deepest


def blocks(text: str) -> list[tuple]:
    """Functions and classes of Python source, outer ones first; none where it can't be parsed."""
    out: list[tuple] = []
    todo = [(n, "") for n in ast.iter_child_nodes(tree)][::-1] if (tree := parse(text)) else []
    while todo:
        one, owner = todo.pop()
        inner = owner
        if isinstance(one, (*FUNCTIONS, ast.ClassDef)):
            inner = f"{owner}.{one.name}" if owner else one.name
        if isinstance(one, FUNCTIONS):
            a = one.args
            params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
            paths, load, depth = complexity(one)
            out.append(("function", one.name, owner, one.lineno, one.end_lineno, params, isinstance(one, ast.AsyncFunctionDef), paths, depth, load, []))
        elif isinstance(one, ast.ClassDef):
            out.append(("class", one.name, owner, one.lineno, one.end_lineno, 0, False, 0, 0, 0, [name_of(b) for b in one.bases]))
        todo.extend([(c, inner) for c in ast.iter_child_nodes(one)][::-1])
    return out


def imports(text: str) -> list[tuple[str, int]]:
    """Modules that Python source imports, with the line; a relative import keeps its dots."""
    tree = parse(text)
    out = []
    for n in below(tree, lambda _: True) if tree else ():
        if isinstance(n, ast.Import):
            out += [(a.name, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.append(("." * n.level + (n.module or ""), n.lineno))
    return out
