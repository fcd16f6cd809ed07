"""Languages with braces, read by the heads and matching braces of their blocks, not by a grammar."""

from __future__ import annotations

import re

_CLASS = re.compile(r"\b(class|interface|struct|enum|trait|impl)\s+([A-Za-z_]\w*)([^{};()]*)$")
_TYPE_GO = re.compile(r"\btype\s+([A-Za-z_]\w*)\s+(struct|interface)\s*$")
_FUNCTION = re.compile(r"(?:^|[\s*&~:>)])([A-Za-z_$]\w*)\s*(?:<[^<>]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:->\s*|:\s*)?[\w\s<>\[\],.*&:?()|]*(?:=>\s*)?$")
_BASES = re.compile(r"(?:\bextends\b|\bimplements\b|:)\s*([^{]+)")
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "select", "synchronized", "using", "lock", "foreach", "new", "when", "with", "func", "function"}
_STEP = re.compile(r"\b(?:if|for|while|case|catch|foreach)\b|&&|\|\||\?(?![.?:])")


_STRING = r'''"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`'''
_COMMENT = re.compile(rf"({_STRING})|//[^\n]*|/\*.*?\*/", re.S)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_comments(text: str) -> str:
    """The text with blanks for its comments; every other character stays in its place."""
    return _COMMENT.sub(lambda m: m[1] or _blank(m[0]), text)


def without_literals(text: str) -> str:
    """As ``without_comments``, and with blanks between the quotes of literals."""
    return _COMMENT.sub(lambda m: m[1][0] + _blank(m[1][1:-1]) + m[1][-1] if m[1] else _blank(m[0]), text)


def _load(body: str) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a function's text: a step counts once more for each brace around it."""
    paths, load, depth = 1, 0, 0
    for m in re.finditer(rf"[{{}}]|{_STEP.pattern}", body):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        else:
            paths, load = paths + 1, load + 1 + max(0, depth - 1)
    return paths, max(paths, load)


def brace_blocks(text: str) -> list[tuple]:
    """Functions and classes of a language with braces, by their heads and matching braces; an unclosed one ends with the text."""
    return [b[:11] for b in brace_spans(text)]


def brace_spans(text: str) -> list[tuple]:
    """The blocks, and the offsets of each one's head and closing brace."""
    bare = without_literals(text)
    out: list[list] = []
    opened: list[int | None] = []
    line, head, head_line, round_depth = 1, 0, None, 0

    def close(at: int, end: int) -> None:
        block = out[at]
        block[4], block[13] = end, here + 1
        if block[0] == "function":
            block[7], block[9] = _load(bare[block[11] : here])

    for here, c in enumerate(bare):
        if c == "\n":
            line += 1
        elif head_line is None and not c.isspace() and c not in "{};":
            head_line = line
        if c in "()":
            round_depth = max(0, round_depth + (1 if c == "(" else -1))
        if c == "{":
            # a receiver before a Go function's name is no parameter list
            found, start = re.sub(r"\bfunc\s*\([^()]*\)\s*", "func ", bare[head:here].strip()), head_line or line
            owner = ".".join(out[i][1] for i in opened if i is not None)
            made = None
            if m := _CLASS.search(found):
                bases = [b.strip() for part in _BASES.findall(m[3]) for b in re.split(r",|\bimplements\b|\bextends\b", part)]
                made = ["class", m[2], owner, start, line, 0, False, 0, 0, 0, [re.sub(r"^(public|private|protected|virtual)\s+", "", b) for b in bases if b]]
            elif m := _TYPE_GO.search(found):
                made = ["class", m[1], owner, start, line, 0, False, 0, 0, 0, []]
            elif (m := _FUNCTION.search(found)) and m[1] not in _NOT_FUNCTIONS and not re.match(r"(?:else|return|throw)\b", found):
                params = len([p for p in re.sub(r"<[^<>]*>|\([^()]*\)", "", m[2]).split(",") if p.strip() and p.strip() != "void"])
                made = ["function", m[1], owner, start, line, params, bool(re.search(r"\basync\b", found)), 1, 0, 1, []]
            if made:
                out.append([*made, here, head + len(bare[head:here]) - len(bare[head:here].lstrip()), here])
                opened.append(len(out) - 1)
            else:
                opened.append(None)
                inside = [i for i in opened if i is not None and out[i][0] == "function"]
                if inside:
                    level = sum(1 for i in opened[opened.index(inside[-1]) :] if i is None)
                    out[inside[-1]][8] = max(out[inside[-1]][8], level)
        elif c == "}" and opened:
            at = opened.pop()
            if at is not None:
                close(at, line)
        if c in "{}" or (c == ";" and not round_depth):
            head, head_line = here + 1, None
    here = len(bare)
    for at in opened:
        if at is not None:
            close(at, line)
    return [(*b[:11], b[12], b[13]) for b in out]
