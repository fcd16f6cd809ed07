import base64
import hashlib
import json
import random
import re

from quarryline.llm import queries, secrets

RULES = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text or ""):
            if len(m[2]) >= 8 if kind == "assign" else len(m[0]) >= (16 if kind == "access" else 32):
                out.append((m.start(), list(RULES).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def row(i, text):
    found = brute(text)
    return (i, *(sum(s.startswith(k) for s in found) for k in RULES), hashlib.sha256(",".join(found).encode()).hexdigest())


def token(prefix):
    body = "abcDEF0123456789ghiJKLmnoPQRst"
    return f"{prefix}{body}{secrets.base62_crc(body)}"


def jwt():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part({'alg': 'none'})}.{part({'sub': 1})}.c2ln"


def texts():
    rng = random.Random(4)
    pieces = ["password", "PassWord", "passwd", "secret", "token", "toKen", "api_key", "ApiKey", "api__key", "=", ":", " ", "  ", '"', "'", "hunter2", "hunter2hunter2", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef" * 2, "f", "g", "é", "İ", "\n", ".", "日"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(600)] + ["", "a" * 32, "a" * 31, "x" + "b" * 63 + "y", "token=short token=longenough1", "İ" * 50 + "secret: 12345678", "e" * 40_000]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "token=abcdefgh1"), (1, texts()[1]), (9999, None)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    out = secrets.find_secrets(df).collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out), key=str) == sorted((row(i, t) for i, t in rows), key=str)
    for r in out:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_checksums(spark):
    good = token("ghp_")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    rows = [(1, f"x {good} y"), (2, f"x {bad} y"), (3, token("npm_")), (4, f"see {jwt()}"), (5, "see eyJabc.eyJdef.ghi"), (6, "IBAN DE89 3704 0044 0532 0130 00."), (7, "IBAN DE88 3704 0044 0532 0130 00.")]
    out = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "ghtoken:2:42", 2: "", 3: "npmtoken:0:40", 4: f"jwt:4:{4 + len(jwt())}", 5: "", 6: "iban:5:32", 7: ""}


def test_empty(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r)[:5] for r in queries.op8_secrets(spark, sf_dir).collect()) == sorted(row(r.doc_id, r.text) for r in docs)
