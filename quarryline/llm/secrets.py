"""Secret scan: Aho-Corasick prefilter, anchored expressions near its hits, checksum validation.

An automaton finds the keywords in one pass over the text. Only at a keyword's
place is the kind's expression tried, anchored there. Kinds whose tokens carry
a checksum are reported only if it holds.

Base kinds, leftmost and non-overlapping each:

* ``assign``  keyword, optional quote, ``:`` or ``=``, optional quote, value of 8 or more characters;
* ``access``  ``AKIA`` and upper-case letters or digits, 16 or more characters;
* ``hex``     32 or more of ``0-9a-f``. It has no keyword; the prefilter probes
  every 32nd character instead, one of which any such run holds.

Added kinds, each with its keyword and checksum: ``ghtoken`` and ``npmtoken``
(base-62 CRC-32 of the random part in the last six characters), ``jwt`` (header
and payload must decode to JSON objects) and ``iban`` (remainder 1 modulo 97
after the word IBAN).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.common import process_cache, slices

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_CHARS = frozenset("0123456789abcdef")
_GH = re.compile(r"gh[oprsu]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_IBAN = re.compile(r"(?i:iban)[\x20:=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.ASCII)
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "ghtoken", "npmtoken", "jwt", "iban")
_WORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "npm_": "npmtoken", "eyj": "jwt", "iban": "iban"} | {f"gh{c}_": "ghtoken" for c in "oprsu"}
_UPPER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out


def _crc_holds(match: re.Match) -> bool:
    return base62_crc(match[1]) == match[2]


def _jwt_holds(match: re.Match) -> bool:
    try:
        return all(isinstance(json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))), dict) for p in match.groups())
    except (ValueError, binascii.Error, RecursionError):
        return False


def iban_holds(number: str) -> bool:
    """Length of at most 34 and remainder 1 modulo 97, letters counting from 10."""
    bare = number.replace(" ", "")
    return len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


#: kind: expression, test of a match, group whose span is reported.
_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 8, 0),
    "access": (_ACCESS, lambda m: len(m[0]) >= 16, 0),
    "ghtoken": (_GH, _crc_holds, 0),
    "npmtoken": (_NPM, _crc_holds, 0),
    "jwt": (_JWT, _jwt_holds, 0),
    "iban": (_IBAN, lambda m: iban_holds(m[1]), 1),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in _WORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _hex_runs(text: str) -> list[tuple[int, int]]:
    runs, done = [], 0
    for at, char in enumerate(text[31::32]):
        place = at * 32 + 31
        if char in _HEX_CHARS and place >= done:
            start = place
            while start > 0 and text[start - 1] in _HEX_CHARS:
                start -= 1
            done = _HEX.match(text, start).end()
            if done - start >= 32:
                runs.append((start, done))
    return runs


def spans(text: str, words) -> list[tuple[str, int, int]]:
    """``kind, start, end`` in code points, by start, then kind as listed."""
    low = text.lower() if text.isascii() else text.translate(_UPPER)
    hits = sorted({(end - size + 1, kind) for end, (kind, size) in words.iter(low)})
    out = [("hex", a, b) for a, b in _hex_runs(text)]
    done = dict.fromkeys(_RULES, 0)
    for at, kind in hits:
        if at < done[kind]:
            continue
        rule, holds, group = _RULES[kind]
        if match := rule.match(text, at):
            done[kind] = match.end()  # a match that fails its test still takes its characters
            if holds(match):
                out.append((kind, *match.span(group)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = process_cache("secret-words", automaton)
    for part in slices(batches):
        rows = []
        for text in part.column(1).to_pylist():
            found = spans(text or "", words)
            tell = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
            base = [s for s in found if s[0] in BASE]
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(tell(base).encode()).hexdigest(), tell(found)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], [c.split()[0] for c in OUT.split(", ")])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs(doc_id, text)``.

    A narrow operation: no shuffle. Null or empty text: no spans. Null
    doc_ids and repeated rows are returned as they are. Empty table: no rows.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_scan, OUT)
