"""Private data under format-preserving pseudonyms, with Spark's own functions only.

Numbers and dates that pass their validation are permuted within their format
by a keyed Feistel network, so that equal values have equal pseudonyms in all
documents and different values different ones:

* ``card``   13 to 19 digits of Luhn remainder 0: payload permuted, check digit computed anew;
* ``iban``   remainder 1 modulo 97: digits of the account part permuted, check digits computed anew;
* ``ssn``    ddd-dd-dddd of an issued range: nine digits permuted within the issued numbers;
* ``phone``  ten digits in the form (ddd) ddd-dddd or with dots, dashes or blanks: permuted;
* ``ip``     four numbers up to 255: permuted as one of 2**32;
* ``date``   real days from 1900 to 2099, year first, or day and month first: the day is permuted within these years.

Addresses of electronic mail have no fixed format; their local part and host
become a keyed hash under the reserved domain ``example.invalid``.

Digits, separators and lengths stay, but for addresses of four parts: these are
permuted as numbers and written without leading zeros, so that their parts may
grow or shrink and `010.1.2.3` shares `10.1.2.3`'s pseudonym. The key stands in the
plan and so in Spark's UI and event log. Text around a match is untouched. A number
that fails its validation is no private datum and stays.

The network is unbalanced as in published format-preserving schemes: the halves
take turns, ``a, b = b, (a + F(key, round, b)) mod 10**len``, with SHA-256 for F.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.native import let, quoted

ROUNDS = 8
WALK = 200
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
#: One alternative a kind; where two could start at one place, the earlier one is tried first.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])",
    "card": r"(?<![\w.+-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w-])",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w-])",
    "ip": r"(?<![\w.+-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d)",
    "date": r"(?<![\w.+/-])(?:(?:19|20)\d{2}([-/.])\d{2}\3\d{2}|\d{2}([-/.])\d{2}\4(?:19|20)\d{2})(?![\w/-])",
}
#: All kinds as one expression; its back-references are numbered from its start.
ANY = "|".join(PATTERNS[kind] for kind in KINDS)
FIRST_DAY, DAYS = -25567, 73049  # days from 1970-01-01 of 1900-01-01; days to 2099-12-31


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def feistel(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36; a single digit is shifted.

    Strings of different lengths or tweaks are permuted independently.
    """

    def whole(d: Column) -> Column:
        n = F.length(d)
        u = (n / 2).cast("int")
        v = n - u

        def step(state: Column, i: Column) -> Column:
            size = F.when(i % 2 == 0, u).otherwise(v)
            mark = F.concat_ws(":", F.lit(key), F.lit(tweak), n.cast("string"), i.cast("string"), state["b"].cast("string"))
            f = F.conv(F.substring(F.sha2(mark, 256), 1, 15), 16, 10).cast("long")
            m = _power(size)
            return F.struct(state["b"].alias("a"), ((state["a"] + f % m) % m).alias("b"))

        start = F.struct(F.substring(d, F.lit(1), u).cast("long").alias("a"), F.substring(d, u + 1, v).cast("long").alias("b"))
        end = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))
        shift = F.conv(F.substring(F.sha2(F.lit(f"{key}:{tweak}:1"), 256), 1, 15), 16, 10).cast("long")
        return F.when(n == 1, ((d.cast("long") + shift) % 10).cast("string")).otherwise(end)

    return let(digits, whole)


def permuted_below(number: Column, limit: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. limit - 1: the digits' permutation, repeated until it falls below ``limit``."""
    width = len(str(limit - 1))
    return permuted_within(F.lpad(number.cast("string"), width, "0"), lambda x: x.cast("long") < limit, key, tweak).cast("long")


def permuted_within(digits: Column, valid: Callable[[Column], Column], key: str, tweak: str) -> Column:
    """A keyed permutation of the valid digit strings of a length: the permutation of all, repeated until it gives a valid one.

    At least a tenth of all strings must be valid; the chance that ``WALK``
    steps find none is then below 1e-9 a value, and for the kinds here below
    1e-45. Past that the last, invalid string stands, still one of its own.
    """
    walk = lambda x, _: F.when(valid(x), x).otherwise(feistel(x, key, tweak))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(digits, key, tweak), walk)


def _into(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""
    place = lambda i: F.length(_digits(F.substring(template, F.lit(1), i)))
    one = lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, place(i + 1), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(template, "", -1), one), "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; the last digit counts once, or twice where a check digit is still to follow."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        x = F.coalesce(c.try_cast("int"), F.lit(0))
        twice = ((n - 1 - i) % 2) == (0 if doubled_last else 1)
        return F.when(twice, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.transform(F.split(digits, "", -1), value), F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """Remainder of the number in which A counts 10 and Z 35."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97).when(c.rlike(r"^\d$"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise(acc)

    return F.aggregate(F.split(text, "", -1), F.lit(0), step)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    valid = (luhn_sum(d, False) % 10 == 0) & d.rlike("[1-9]")

    def put(p: Column) -> Column:
        return _into(m, F.concat(p, ((10 - luhn_sum(p, True) % 10) % 10).cast("string")))

    return valid, let(feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), put)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    size = F.length(bare)
    valid = (mod97(F.concat(F.substring(bare, F.lit(5), size), F.substring(bare, 1, 4))) == 1) & size.between(15, 34)
    inner = F.substring(bare, F.lit(5), size)
    new = F.when(_digits(inner) == "", inner).otherwise(_into(inner, feistel(_digits(inner), key, "iban")))

    def put(b: Column) -> Column:
        country = F.substring(bare, 1, 2)
        check = F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, b)
        place = lambda i: F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.array_join(F.transform(F.split(m, "", -1), lambda c, i: F.when(c == " ", c).when(c == "", c).otherwise(F.substring(whole, place(i + 1), F.lit(1)))), "")

    return valid, let(new, put)


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.split(m, r"\.")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    valid = F.forall(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) < 256)
    whole = number(0) * 2**24 + number(1) * 2**16 + number(2) * 2**8 + number(3)
    put = lambda x: F.concat_ws(".", *[(F.shiftright(x, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])
    return valid, let(permuted_below(whole, 2**32, key, "ip"), put)


def _date(m: Column, key: str) -> tuple[Column, Column]:
    first = m.rlike(r"^\d{4}")
    a, b, c = (F.regexp_extract(m, r"^(\d+)\D(\d+)\D(\d+)$", i) for i in (1, 2, 3))
    year = F.when(first, a).otherwise(c)
    day_month = F.try_to_date(F.concat_ws("-", c, b, a), "yyyy-MM-dd")
    month_day = F.try_to_date(F.concat_ws("-", c, a, b), "yyyy-MM-dd")
    american = ~first & day_month.isNull()
    day = F.when(first, F.try_to_date(F.concat_ws("-", year, b, c), "yyyy-MM-dd")).otherwise(F.coalesce(day_month, month_day))
    number = F.unix_date(F.coalesce(day, F.lit("1970-01-01").cast("date"))) - FIRST_DAY

    def put(x: Column) -> Column:
        d = F.date_from_unix_date((x + FIRST_DAY).cast("int"))
        y, mo, dd = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
        return _into(m, F.when(first, F.concat(y, mo, dd)).when(american, F.concat(mo, dd, y)).otherwise(F.concat(dd, mo, y)))

    return day.isNotNull(), let(permuted_below(number, DAYS, key, "date"), put)


def _plain(m: Column, key: str, tweak: str) -> Column:
    return _into(m, feistel(_digits(m), key, tweak))


def _issued(digits: Column) -> Column:
    return ~digits.rlike("^(000|666|9)|^...00|0000$")


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    return _issued(d), let(permuted_within(d, _issued, key, "ssn"), lambda x: _into(m, x))


def pseudonym(m: Column, key: str) -> Column:
    """``kind, value`` of one match; kind is null where it fails its validation."""
    # Java's numbered groups differ from one alternative to the next, so each kind is tested by its own shape
    shape = {
        "email": m.contains("@"),
        "iban": m.rlike("^[A-Z]{2}"),
        "card": m.rlike(r"^\d") & (F.length(_digits(m)) >= 13),
        "ssn": m.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "date": m.rlike(r"^(\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})$"),
        "ip": m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
        "phone": m.rlike(r"^\(?\d{3}"),
    }
    mail = F.concat(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))
    rules = {"email": (F.lit(True), mail), "iban": _iban(m, key), "card": _card(m, key), "ssn": _ssn(m, key), "date": _date(m, key), "ip": _ip(m, key), "phone": (F.lit(True), _plain(m, key, "phone"))}
    keep = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    made = reduce(lambda chain, k: chain.when(shape[k], F.when(rules[k][0], F.struct(F.lit(k).alias("kind"), rules[k][1].alias("value"))).otherwise(keep)), list(shape)[1:], F.when(shape["email"], F.struct(F.lit("email").alias("kind"), mail.alias("value"))))
    return made.otherwise(keep)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with private data in ``text_col`` replaced, and a count ``n_<kind>`` of each kind.

    A narrow operation: no shuffle. Null text stays null and counts 0; empty
    text stays empty; very long texts are worked on whole. Other columns of any
    name, null ids and repeated rows pass through; input columns named as a
    count are replaced by it. Empty table: no rows.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    # the input rides along as a struct, so that no column of its own can clash with the work's
    cell = lambda c: docs[quoted([c])[0]]
    text = cell(text_col)
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key))
    rows = docs.select(F.struct(*([cell(c) for c in docs.columns if c not in counts and c != text_col] or [text])).alias("row"), text.alias("text"), found.alias("found"))

    def join(g: Column) -> Column:
        return F.array_join(F.transform(F.arrays_zip(g.alias("g"), F.col("found").alias("f")), lambda x: F.concat(x["g"], F.coalesce(x["f"]["value"], F.lit("")))), "")

    # a text without a match is never split
    new = F.when(F.size("found") > 0, let(F.split("text", ANY, -1), join)).otherwise(F.col("text"))
    n = lambda kind: F.when(F.col("found").isNull(), 0).otherwise(F.size(F.filter("found", lambda x: x["kind"] == kind)))
    own = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in counts]
    return rows.select(*own, *[n(kind).alias(f"n_{kind}") for kind in KINDS])
