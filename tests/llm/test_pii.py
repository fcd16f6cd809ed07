import datetime
import hashlib
import random
import re
from collections import Counter

import regex

from quarryline.llm import pii, queries

KEY = "k"


def feistel(digits, tweak):
    n = len(digits)
    u, v = n // 2, n - n // 2
    f = lambda i, b: int(hashlib.sha256(f"{KEY}:{tweak}:{n}:{i}:{b}".encode()).hexdigest()[:15], 16)
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(8):
        m = 10 ** (u if i % 2 == 0 else v)
        a, b = b, (a + f(i, b)) % m
    return f"{a:0{u}d}{b:0{v}d}"


def below(x, limit, tweak):
    width = len(str(limit - 1))
    while True:
        x = int(feistel(f"{x:0{width}d}", tweak))
        if x < limit:
            return x


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10


def card(d):
    p = feistel(d[:-1], "card")
    return p + str(next(c for c in range(10) if luhn(p + str(c)) == 0))


def issued(d):
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(d):
    while True:
        d = feistel(d, "ssn")
        if issued(d):
            return d


def into(template, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in template)


def plain_value(m):
    """Kind and pseudonym of one match, or no kind."""
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", hashlib.sha256(f"{KEY}:email:{m.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if re.match("[A-Z]{2}", m):
        bare = m.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not (15 <= len(bare) <= 34 and number(bare[4:] + bare[:4]) % 97 == 1):
            return None, m
        inner = into(bare[4:], feistel(re.sub("[^0-9]", "", bare[4:]), "iban"))
        whole = iter(bare[:2] + f"{98 - number(inner + bare[:2] + '00') % 97:02d}" + inner)
        return "iban", "".join(c if c == " " else next(whole) for c in m)
    if re.match("[0-9]", m) and len(d) >= 13:
        return ("card", into(m, card(d))) if luhn(d) == 0 and d.strip("0") else (None, m)
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return ("ssn", into(m, ssn(d))) if issued(d) else (None, m)
    if x := re.fullmatch(r"(\d{4})[-/.](\d\d)[-/.](\d\d)|(\d\d)[-/.](\d\d)[-/.](\d{4})", m):
        y, *two = (x[1], x[2], x[3]) if x[1] else (x[6], x[5], x[4])
        for order, (mo, dd) in enumerate([two] if x[1] else [two, two[::-1]]):
            try:
                day = datetime.date(int(y), int(mo), int(dd))
            except ValueError:
                continue
            first = datetime.date(1900, 1, 1)
            new = first + datetime.timedelta(days=below((day - first).days, pii.DAYS, "date"))
            return "date", into(m, new.strftime("%Y%m%d" if x[1] else "%m%d%Y" if order else "%d%m%Y"))
        return None, m
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return None, m
        new = below(sum(x << s for x, s in zip(parts, (24, 16, 8, 0), strict=True)), 2**32, "ip")
        return "ip", ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    return "phone", into(m, feistel(d, "phone"))


ANY = regex.compile(pii.ANY.replace("[\\w]", "[A-Za-z0-9_]").replace("\\w", "A-Za-z0-9_").replace("\\d", "[0-9]"))


def plain(text):
    counts = Counter()

    def put(m):
        kind, value = plain_value(m[0])
        counts[kind] += 1
        return value

    return ANY.sub(put, text), counts


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_card string")
    rows = sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], rows


def test_values(spark):
    d = datetime.date(1900, 1, 1)
    day = lambda x: d + datetime.timedelta(days=below((x - d).days, pii.DAYS, "date"))
    leap = day(datetime.date(2024, 2, 29))
    ip = below(97 * 2**24 + 51 * 2**16 + 17 * 2**8 + 173, 2**32, "ip")
    cases = {
        "card 7536784127813050.": f"card {card('7536784127813050')}.",
        "9807915762804490 fails": "9807915762804490 fails",
        "a 2024-02-29 b": f"a {leap:%Y-%m-%d} b",
        "29.02.2024, 02/29/2024": f"{leap:%d.%m.%Y}, {leap:%m/%d/%Y}",
        "2023-02-29 1899-01-01": "2023-02-29 1899-01-01",
        "97.51.17.173 and 300.1.1.1": f"{ip >> 24}.{ip >> 16 & 255}.{ip >> 8 & 255}.{ip & 255} and 300.1.1.1",
        "+1 (974) 555-3436": "+1 ({}{}{}) {}{}{}-{}{}{}{}".format(*feistel("9745553436", "phone")),
        "123-45-6789 000-12-3456": "{}{}{}-{}{}-{}{}{}{} 000-12-3456".format(*ssn("123456789")),
        "": "",
        "no data, v1.2.3 and 12345": "no data, v1.2.3 and 12345",
    }
    got, _ = run(spark, list(cases))
    assert got == list(cases.values())


def test_iban_and_mail(spark):
    got, rows = run(spark, ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432 x", "DE88 3704 0044 0532 0130 00", "Leó.90@mail2.Example.com and leó.90@mail2.example.com", "a@b"])
    for text, shape in zip(got[:2], (r"DE\d\d( \d{4}){4} \d\d", r"GB\d\dWEST\d{14} x"), strict=True):
        assert re.fullmatch(shape, text)
        bare = text.replace(" ", "").removesuffix("x")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert got[2] == "DE88 3704 0044 0532 0130 00" and got[4] == "a@b"
    first, second = got[3].split(" and ")
    assert first == second and first.endswith("@example.invalid") and rows[3].n_email == 2


def test_linked_distinct_and_counted(spark):
    rng = random.Random(1)
    cards = []
    while len(cards) < 300:
        p = "".join(rng.choice("0123456789") for _ in range(15))
        cards.append(p + str(next(c for c in range(10) if luhn(p + str(c)) == 0)))
    got, rows = run(spark, [f"{c} then {c}" for c in cards])
    pairs = [t.split(" then ") for t in got]
    assert all(a == b and luhn(a) == 0 for a, b in pairs) and len({a for a, _ in pairs}) == len(set(cards))
    assert all(r.n_card == 2 for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "4111111111111111"), (1, None), (1, None), (2, "x " * 60_000 + "4111111111111111")], "doc_id long, text string")
    out = pii.pseudonymise(df, KEY).collect()
    assert len(out) == 4 and sum(r.n_card for r in out) == 2 and [r.text for r in out if r.doc_id == 1] == [None, None]
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_social_numbers_stay_issued(spark):
    rng = random.Random(5)
    numbers = sorted({f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(3000)})
    got, rows = run(spark, numbers)
    assert all(issued(t.replace("-", "")) for t in got) and len(set(got)) == len(numbers)
    assert all(r.n_ssn == 1 for r in rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "123-45-6789", "a", "b", "c", "d")], "doc_id long, text string, _found string, found string, row string, _ string")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == [*df.columns, *[f"n_{k}" for k in pii.KINDS]]
    (r,) = out.collect()
    assert (r["_found"], r["found"], r["row"], r["_"], r["n_ssn"]) == ("a", "b", "c", "d", 1)


def test_query_matches_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: r for r in queries.op2_pii(spark, sf, key=KEY).collect()}
    assert out.keys() == docs.keys()
    seen = Counter()
    for i, t in docs.items():
        text, counts = plain(t)
        assert out[i].text == text
        assert {k: out[i][f"n_{k}"] for k in pii.KINDS} == {k: counts[k] for k in pii.KINDS}
        seen += counts
    assert {"card", "date", "email", "ip", "phone", "ssn"} & seen.keys(), seen


def test_query_on_its_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in queries.op2_pii(spark, sf_dir).collect()}
    assert out.keys() == docs.keys()
    changed = 0
    for i, t in docs.items():
        assert not re.search(r"@mail\d\.example\.com", out[i].text)
        total = sum(out[i][f"n_{k}"] for k in pii.KINDS)
        changed += total
        if not total:
            assert out[i].text == t
        elif not out[i].n_email:
            assert re.sub(r"\d", "0", out[i].text) == re.sub(r"\d", "0", t) or out[i].n_ip
    assert changed
