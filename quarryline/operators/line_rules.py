"""Rules that one line decides.

What a rule looks for is written in a small vocabulary: a call of a name, an
object made, a declaration, a key set to a value. Each entry says for which
languages it holds; the grades are in ``rule_catalog``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.rule_catalog import RULES, rule_table
from quarryline.operators.rules import plausible_secret

QUOTE = "[\"'`]"
CONFIG = "config"
#: Start of a comment line by language; others have ``//``, ``/*`` and its ``*``.
COMMENTS = {"python": r"^\s*#", "ruby": r"^\s*#", "r": r"^\s*#", "lua": r"^\s*--", "config": r"^\s*[#;]", "php": r"^\s*(#|//|/\*|\*(\s|/|$))"}
SLASHES = r"^\s*(//|/\*|\*(\s|/|$))"


def _name(name: str) -> str:
    """A dotted name, blanks allowed around its dots."""
    return r"\s*(?:\.|::)\s*".join(map(re.escape, re.split(r"\.|::", name)))


def call(*names: str, first: str = "") -> str:
    """A call of one of the names, not as another name's end; ``first`` is how its arguments begin."""
    return rf"(?<![\w.:])(?:{'|'.join(map(_name, names))})\s*\(\s*{first}"


def method(*names: str, first: str = "") -> str:
    return rf"\.\s*(?:{'|'.join(names)})\s*\(\s*{first}"


def made(*types: str, first: str = "") -> str:
    """``new T(``, the type perhaps within a package."""
    return rf"\bnew\s+(?:\w+\s*\.\s*)*(?:{'|'.join(types)})\s*(?:<[^>]*>)?\s*\(\s*{first}"


def macro(*names: str) -> str:
    return rf"(?<![\w.:])(?:{'|'.join(names)})!\s*[(\[{{]"


def caught(*types: str) -> str:
    """A handler for one of the types, perhaps among others."""
    return rf"\bcatch\s*\((?:[^)]*[\s|(.:])?(?:{'|'.join(types)})\b[^)]*\)"


def key_set(keys: str, value: str) -> str:
    """A key, perhaps in quotes, set by ``=`` or ``:`` to a value, perhaps in quotes."""
    return rf"(?i)(?<![A-Za-z0-9]){QUOTE}?(?:{keys}){QUOTE}?\s*[:=]\s*{QUOTE}?(?:{value})(?![\w.-]){QUOTE}?"


def thrown(*types: str) -> str:
    return rf"\bthrow\s+new\s+(?:\w+\s*\.\s*)*(?:{'|'.join(types)})\b"


UNDONE = rf"{QUOTE}(?i:todo|fixme|stub|not\s+(?:yet\s+)?implemented|unimplemented)"
# Words of money.
MONEY_WORDS = ["amount", "balance", "bonus", "cost", "fee", "money", "payment", "price", "refund", "salary", "tax", "total", "wage"]
MONEY = rf"(?i:[a-z0-9_]*(?:{'|'.join(MONEY_WORDS)})[a-z0-9_]*)"
SECRET_WORDS = "pass(?:word|wd|phrase)?|secret|token|credential|api[_-]?key"
SQL_TEXT = r"[\"'`]\s*(?i:select\b.*\bfrom|insert\s+into|update\b.*\bset|delete\s+from)\b"
REQUEST = r"(?i:\b(?:req|request|params|query|args|input|user_?input)\b)"
WHOLE_ROWS = r"(?i)\bselect\s+\*\s+from\s+\w+"
BOUNDED = r"(?i)\b(?:limit|top|fetch\s+(?:first|next)|where|rownum)\b"

JS = ("javascript", "typescript")
ALL_CODE = ("python", "java", *JS, "go", "cpp", "c", "csharp", "lua", "rust", "ruby", "php")

#: Rule, languages, expression of what it flags, and, where there is one, what excuses the line.
CHECKS: list[tuple[str, tuple[str, ...], str] | tuple[str, tuple[str, ...], str, str]] = [
    ("DEAD-CODE", ALL_CODE, r"(?:#|//|--|/\*|^\s*\*).*\b(?:TODO|FIXME|HACK|XXX)\b.*\b(?i:unused|dead|obsolete|remove|delete|drop|clean\s?up)"),
    ("EMPTY-EXCEPT", ("java", *JS, "cpp", "csharp"), r"\bcatch\b[^{}]*\{\s*\}"),
    ("PRINT-DEBUG", JS, call("console.log", "console.debug", "console.trace", "console.dir")),
    ("PRINT-DEBUG", ("java",), r"\bSystem\s*\.\s*(?:out|err)\s*\.\s*print\w*\s*\(|" + method("printStackTrace")),
    ("PRINT-DEBUG", ("go",), r"\bfmt\s*\.\s*F?[Pp]rint(?:f|ln)?\s*\(|" + call("println", "print")),
    ("PRINT-DEBUG", ("cpp", "c"), r"\bc(?:out|err)\s*<<|" + call("printf", "puts", "std::printf")),
    ("PRINT-DEBUG", ("csharp",), call("Console.Write", "Console.WriteLine", "Console.Error.WriteLine", "Debug.Write", "Debug.WriteLine", "Debug.Print")),
    ("PRINT-DEBUG", ("rust",), macro("println", "print", "eprintln", "dbg")),
    ("PRINT-DEBUG", ("lua",), call("print")),
    ("ASSERT-USED", ("java",), r"^\s*assert\s+[^;]+;"),
    ("ASSERT-USED", ("cpp", "c", "lua"), call("assert")),
    ("ASSERT-USED", ("csharp",), call("Debug.Assert", "Trace.Assert")),
    ("ASSERT-USED", JS, call("console.assert", "assert")),
    ("ASSERT-USED", ("rust",), macro("assert", "assert_eq", "assert_ne")),
    ("BROAD-EXCEPT", ("java",), caught("Exception", "Throwable", "RuntimeException")),
    ("BROAD-EXCEPT", ("csharp",), caught("Exception")),
    ("BROAD-EXCEPT", ("cpp",), caught("exception")),
    ("BARE-EXCEPT", ("cpp",), r"\bcatch\s*\(\s*\.{3}\s*\)"),
    ("STUB-IN-PROD", ("python",), r"\braise\s+NotImplementedError\b"),
    ("STUB-IN-PROD", ("java", "csharp"), thrown("UnsupportedOperationException", "NotImplementedException", "NotImplementedError")),
    ("STUB-IN-PROD", JS, thrown("Error") + r"\s*\(\s*" + UNDONE),
    ("STUB-IN-PROD", ("go",), call("panic", first=UNDONE)),
    ("STUB-IN-PROD", ("rust",), macro("todo", "unimplemented")),
    ("STUB-IN-PROD", ("cpp",), r"\bthrow\s+(?:std::)?\w+\s*\(\s*" + UNDONE),
    ("MONEY-FLOAT-PRECISION", ("java", "csharp", "cpp"), rf"\b(?i:float|double)\s+{MONEY}\s*[=;,)]"),
    ("MONEY-FLOAT-PRECISION", ("python", *JS), rf"(?<!\w){MONEY}\s*\??:\s*(?:float|number)\b"),
    ("MONEY-FLOAT-PRECISION", ("go",), rf"\b{MONEY}\s+float(?:32|64)\b"),
    ("BIGDECIMAL-DOUBLE-CTOR", ("java",), made("BigDecimal", first=r"[-+]?(?=[\d_]*(?:\.|[eEdDfF]))[\d_.]+(?:[eE][-+]?\d+)?[dDfF]?\s*\)")),
    ("STATIC-SIMPLEDATEFORMAT", ("java",), r"\bstatic\b[^=;()]*\bSimpleDateFormat\s+\w+"),
    ("MISSING-CHARSET", ("java",), method("getBytes", first=r"\)") + "|" + made("String", "FileReader", "FileWriter", "InputStreamReader", "OutputStreamWriter", first=r"(?![\"'])(?:[^(),]|\([^()]*\))+\)")),
    ("ASYNC-VOID", ("csharp",), r"\basync\s+void\s+\w+\s*\((?![^)]*EventArgs)"),
    ("UTF8-BYTE-TRUNCATE", ("java",), made("String", first=r"(?:\w*[bB]ytes\w*|[^,]*getBytes\([^)]*\))\s*,\s*0\s*,\s*(?!\w*[bB]ytes\w*\.length)\w+")),
    ("INTEGER-DIVISION-PRECISION", ("java",), r"\b(?:double|float)\s+\w+\s*=\s*\(?\s*(?:\w+|\d+)\s*/\s*(?:\w+|\d+)\s*\)?\s*;", r"\d\.\d|\d[dDfF]\b|\((?:double|float)\)"),
    ("PAGINATION-INTEGER-DIVISION", ("java",), r"(?i)\b(?:total_?pages|page_?count|pages)\w*\s*=\s*\w*(?:total|count|size)\w*\s*/\s*\w*(?:page|size|limit)\w*\s*;"),
    ("ASSIGNMENT-IN-CONDITION", ("java",), r"\b(?:if|while)\s*\(\s*!?\s*\w+\s*=\s*(?:true|false|\w+)\s*\)"),
    ("EVAL-USAGE", JS, call("eval", "Function", first="") + "|" + call("setTimeout", "setInterval", first=QUOTE)),
    ("EVAL-USAGE", ("lua",), call("loadstring", "load", "dofile")),
    ("WEAK-HASH", ("java",), call("MessageDigest.getInstance", first=r"\"(?i:md2|md5|sha-?1)\"") + "|" + call("DigestUtils.md5Hex", "DigestUtils.sha1Hex", "Hashing.md5", "Hashing.sha1")),
    ("WEAK-HASH", JS, r"\bcreateH(?:ash|mac)\s*\(\s*[\"'`](?i:md5|sha1)[\"'`]"),
    ("WEAK-HASH", ("go",), call("md5.New", "md5.Sum", "sha1.New", "sha1.Sum")),
    ("WEAK-HASH", ("cpp", "c"), call("MD5", "SHA1", "MD5_Init", "SHA1_Init", "EVP_md5", "EVP_sha1")),
    ("WEAK-HASH", ("csharp",), call("MD5.Create", "SHA1.Create") + "|" + made("MD5CryptoServiceProvider", "SHA1CryptoServiceProvider", "SHA1Managed")),
    ("INSECURE-RANDOM", ("python",), call("random.random", "random.randint", "random.randrange", "random.choice", "random.choices", "random.sample", "random.getrandbits")),
    ("INSECURE-RANDOM", ("java",), call("Math.random", "ThreadLocalRandom.current") + "|" + made("Random")),
    ("INSECURE-RANDOM", JS, call("Math.random")),
    ("INSECURE-RANDOM", ("go",), r"\brand\s*\.\s*(?:Int|Uint|Float|Perm|Read)\w*\s*\("),
    ("INSECURE-RANDOM", ("cpp", "c"), call("rand", "srand", "random", "std::rand")),
    ("INSECURE-RANDOM", ("csharp",), made("Random")),
    ("INSECURE-RANDOM", ("lua",), call("math.random")),
    ("UNSAFE-DESERIALIZATION", ("java",), made("ObjectInputStream", "XMLDecoder") + "|" + method("readObject", "readUnshared", first=r"\)")),
    ("UNSAFE-DESERIALIZATION", ("csharp",), made("BinaryFormatter", "SoapFormatter", "LosFormatter", "NetDataContractSerializer")),
    ("UNSAFE-DESERIALIZATION", JS, call("serialize.unserialize", "unserialize")),
    ("WEAK-CIPHER", ("java",), call("Cipher.getInstance", first=r"\"(?i:des|desede|tripledes|rc2|rc4|arcfour|blowfish)\b") + "|" + call("Cipher.getInstance", first=r"\"[^\"]*/(?i:ecb)/")),
    ("WEAK-CIPHER", ("python",), call("DES.new", "DES3.new", "ARC2.new", "ARC4.new", "Blowfish.new", "modes.ECB", "algorithms.TripleDES") + r"|\bMODE_ECB\b"),
    ("WEAK-CIPHER", ("go",), call("des.NewCipher", "des.NewTripleDESCipher", "rc4.NewCipher")),
    ("WEAK-CIPHER", JS, r"\bcreate(?:Dec|C)ipher(?:iv)?\s*\(\s*[\"'`](?i:des|rc[24]|bf\b|[\w-]*ecb)"),
    ("WEAK-CIPHER", ("csharp",), made("DESCryptoServiceProvider", "TripleDESCryptoServiceProvider", "RC2CryptoServiceProvider") + r"|\bCipherMode\s*\.\s*ECB\b"),
    ("WEAK-CIPHER", ("cpp", "c"), r"\bEVP_(?:des|rc[24]|bf)_?\w*\s*\(|\bEVP_\w+_ecb\s*\("),
    ("INSECURE-TLS-VERIFICATION", ("python",), r"(?<!\w)verify\s*=\s*False\b|" + call("ssl._create_unverified_context") + r"|\bCERT_NONE\b|\bcheck_hostname\s*=\s*False\b"),
    ("INSECURE-TLS-VERIFICATION", ("go",), r"\bInsecureSkipVerify\s*:\s*true\b"),
    ("INSECURE-TLS-VERIFICATION", JS, r"\brejectUnauthorized[\"']?\s*:\s*false\b|\bNODE_TLS_REJECT_UNAUTHORIZED\b[\"'\]]*\s*=\s*[\"']?0\b"),
    ("INSECURE-TLS-VERIFICATION", ("java",), made("NoopHostnameVerifier", "TrustAllStrategy") + r"|\bALLOW_ALL_HOSTNAME_VERIFIER\b|\bset(?:Default)?HostnameVerifier\s*\(\s*\([^)]*\)\s*->\s*true\b|\bcheckServerTrusted\s*\([^)]*\)[^{]*\{\s*\}"),
    ("INSECURE-TLS-VERIFICATION", ("csharp",), r"\bServerCertificate(?:Custom)?ValidationCallback\s*\+?=\s*[^;]*=>\s*true\b|\bDangerousAcceptAnyServerCertificateValidator\b"),
    ("SQL-INJECTION-RISK", ("python",), rf"\bf{SQL_TEXT}[^\"'`]*\{{|{SQL_TEXT}.*[\"'`]\s*(?:\+|%\s*[\w(]|\.\s*format\s*\()"),
    ("SQL-INJECTION-RISK", ("java", "csharp", "go", "cpp", "lua", "rust", "ruby", "php"), rf"{SQL_TEXT}.*[\"']\s*(?:\+|\.\.?)\s*\$?\w|(?:Sprintf|format)!?\s*\(\s*{SQL_TEXT}.*%[sv]"),
    ("SQL-INJECTION-RISK", JS, rf"{SQL_TEXT}.*(?:[\"'`]\s*\+\s*\w|\$\{{)"),
    ("PATH-TRAVERSAL-RISK", ALL_CODE, rf"(?:\b(?:open|fopen|readFile(?:Sync)?|createReadStream|sendFile|send_file|ReadFile|Open)|\bnew\s+File(?:InputStream|Reader)?)\s*\([^)]*{REQUEST}", r"(?i)basename|secure_filename|normalize|sanitiz|realpath|filepath\.Clean"),
    ("COMMAND-INJECTION-RISK", ("python",), rf"(?:{call('os.system', 'os.popen', 'commands.getoutput')})(?:f[\"']|[^)]*(?:\+|%\s|\.format\(|{REQUEST}))"),
    ("COMMAND-INJECTION-RISK", ("java",), r"\bexec\s*\(\s*(?:\"[^\"]*\"\s*\+\s*\w|\w+\s*\+)"),
    ("COMMAND-INJECTION-RISK", JS, rf"\b(?:exec|execSync|spawnSync?)\s*\(\s*(?:`[^`]*\$\{{|[\"'][^\"']*[\"']\s*\+|[^)]*{REQUEST})"),
    ("COMMAND-INJECTION-RISK", ("go",), r"\bexec\s*\.\s*Command\s*\(\s*\"(?:sh|bash|cmd)\"\s*,\s*\"[-/]c\"\s*,\s*(?!\")"),
    ("COMMAND-INJECTION-RISK", ("cpp", "c", "php", "ruby", "lua"), r"(?<![\w.])(?:os\.execute|io\.popen|system|popen|shell_exec|passthru)\s*\(\s*(?!\"[^\"]*\"\s*[,)])(?!'[^']*'\s*[,)])[^)]"),
    ("SSRF-RISK", ("python",), rf"\b(?:requests|httpx|urllib\.request|session)\s*\.\s*(?:get|post|put|delete|head|request|urlopen)\s*\(\s*[^)]*{REQUEST}"),
    ("SSRF-RISK", JS, rf"\b(?:fetch|axios(?:\.\w+)?|got|https?\.get)\s*\(\s*{REQUEST}"),
    ("SSRF-RISK", ("java", "go"), rf"(?:\bnew\s+URL\s*\(\s*|\bhttp\s*\.\s*(?:Get|Post)\s*\(\s*){REQUEST}"),
    ("SELECT-STAR-NO-LIMIT", ("python", "java", *JS, "go", "cpp"), WHOLE_ROWS, BOUNDED),
    ("REDOS-RISK", ("python", "java", *JS, "go", "cpp"), r"(?:re\.\w+|Pattern\.compile|new\s+RegExp|regexp\.\w+|regex|=\s*/|\(\s*/).*\((?:[^()\\]|\\.)*[+*]\)[+*{]"),
    ("DEBUG-MODE-ENABLED", (CONFIG,), key_set(r"(?:\w+[_.])?debug", "true|1|yes|on")),
    ("CORS-WILDCARD", (CONFIG, *ALL_CODE), key_set(r"(?:access[_-]control[_-]allow[_-]origin|\w*cors[_-]?(?:allowed[_-]?)?origins?|allowed?[_-]?origins?)", r"\[?\s*[\"']?\*") + "|" + key_set(r"(?:cors[_-]?(?:origin[_-]?)?allow[_-]?all\w*|allow[_-]all[_-]origins)", "true|1|yes") + r"|(?i)[\"']access-control-allow-origin[\"']\s*,\s*[\"']\*[\"']"),
    ("SENSITIVE-LOG-OUTPUT", ALL_CODE, rf"(?i)\b(?:log(?:ger|ging)?|console|print(?:f|ln)?|fmt\.\w+)\b\s*(?:\.\s*\w+\s*)?\(.*(?<![a-z])(?:{SECRET_WORDS})(?![a-z])", rf"(?i)mask|redact|\*\*\*|^[^\"']*\(\s*[\"'][^\"'{{}}%$]*[\"']\s*\)"),
    ("DOCKER-LATEST-TAG", ("docker",), r"(?i)^\s*FROM\s+(?:--\S+\s+)?(?!scratch\b)[^\s:@$]+(?::latest)?(?:\s+AS\s+\S+)?\s*$"),
]
#: A key that names a secret, set to a literal; the literal is group 1.
SECRET_SET = rf"(?i)(?<![A-Za-z0-9])\w*(?:{SECRET_WORDS}|pwd)\w*[\"']?\s*(?::?=|:)\s*[\"']([^\"']{{4,}})[\"']"
#: In a configuration file the literal needs no quotes.
SECRET_CONFIGURED = rf"(?i)^\s*[\"']?[\w.-]*(?:{SECRET_WORDS}|pwd)[\w.-]*[\"']?\s*[:=]\s*[\"']?([^\s\"',#]{{4,}})"
SECRET_CODE = RULES["HARDCODED-PASSWORD"].languages


def is_comment() -> Column:
    """Whether a ``line`` of ``lang`` begins as a comment."""
    out = F.col("line").rlike(SLASHES)
    for lang, start in COMMENTS.items():
        out = F.when(F.col("lang") == lang, F.col("line").rlike(start)).otherwise(out)
    return out


def _flags(check: tuple) -> Column:
    rule, languages, pattern, *excuse = check
    out = F.col("lang").isin(list(languages)) & F.col("line").rlike(pattern)
    if excuse:
        out &= ~F.col("line").rlike(excuse[0])
    return out if rule == "DEAD-CODE" else out & ~F.col("comment")


def patterns_of() -> dict[str, list[str]]:
    """By language, the expressions of all that is flagged in it, excuses and secrets' plausibility aside."""
    out: dict[str, list[str]] = {}
    for languages, pattern in [*(c[1:3] for c in CHECKS), (SECRET_CODE, SECRET_SET), ((CONFIG,), SECRET_CONFIGURED)]:
        for lang in languages:
            out.setdefault(lang, []).append(pattern)
    return out


def may_hit() -> Column:
    """Whether any expression of its ``lang`` finds something in a ``line``: one search for most lines, which have no hit."""
    out = F.lit(False)
    for lang, patterns in patterns_of().items():
        out = F.when(F.col("lang") == lang, F.col("line").rlike("|".join(f"(?:{p})" for p in patterns))).otherwise(out)
    return out


def line_hits(lines: DataFrame) -> DataFrame:
    """``path, rule_id, line_no, line_end`` of ``path, lang, line_no, line``, in any order: a row a rule and line of the input.

    A narrow operation. Comment lines count for DEAD-CODE only. Null lines and
    lines of an unknown language, null included, have no hits. Repeated lines of
    one path and number are each reported. Rules are told apart only on lines
    where one of them may hit.
    """
    lines = lines.where(may_hit())
    by_rule: dict[str, Column] = {}
    for check in CHECKS:
        by_rule[check[0]] = by_rule[check[0]] | _flags(check) if check[0] in by_rule else _flags(check)
    secret = lambda pattern, rule: F.regexp_extract("line", pattern, 1).alias(rule)
    rows = lines.withColumn("comment", is_comment()).select("*", secret(SECRET_SET, "in_code"), secret(SECRET_CONFIGURED, "in_config"))
    literal = lambda c, lang: lang & ~F.col("comment") & (F.col(c) != "") & plausible_secret(F.col(c))
    by_rule["HARDCODED-PASSWORD"] = literal("in_code", F.col("lang").isin(list(SECRET_CODE)))
    by_rule["CONFIG-HARDCODED-SECRET"] = literal("in_config", F.col("lang") == CONFIG)
    tests = [F.when(flagged, F.lit(rule)) for rule, flagged in by_rule.items()]
    return rows.select("path", F.explode(F.array_compact(F.array(*tests))).alias("rule_id"), "line_no").withColumn("line_end", F.col("line_no"))


def line_rule_table(spark: SparkSession) -> DataFrame:
    """The rules that are decided here, with their grades."""
    names = {c[0] for c in CHECKS} | {"HARDCODED-PASSWORD", "CONFIG-HARDCODED-SECRET"}
    return rule_table(spark).where(F.col("rule_id").isin(sorted(names)))
