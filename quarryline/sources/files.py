"""Source trees as a table of files."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of each language.
EXTENSIONS = {
    "python": ["py", "pyi", "pyx"],
    "java": ["java"],
    "javascript": ["js", "jsx"],
    "typescript": ["ts", "tsx"],
    "go": ["go"],
    "rust": ["rs"],
    "c": ["c"],
    "cpp": ["cpp", "cc", "cxx", "h", "hpp"],
    "csharp": ["cs"],
    "ruby": ["rb"],
    "php": ["php"],
    "swift": ["swift"],
    "kotlin": ["kt"],
    "scala": ["scala"],
    "dart": ["dart"],
    "lua": ["lua"],
    "r": ["r"],
    "objective-c": ["m"],
}
# Languages in order of priority, by tier.
TIERS = [["cpp", "java", "go"], ["lua", "python", "csharp"], ["javascript", "typescript", "rust"]]
# Folders that are skipped, beginnings of folder names of toolkits, places of installed systems.
SKIPPED_FOLDERS = [
    ".git", ".svn", ".hg", ".idea", ".vscode", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "node_modules", ".node_modules", "dist", "build", "target", "out", "bin", "obj", ".tox", ".nox", ".coverage", "htmlcov", ".cache", "reports",
    "third_party", "thirdparty", "3rdparty", "vendor", "vendored", "external", "extern", "deps", "submodules",
    ".npm", ".yarn", ".pnpm-store", "bower_components", ".gradle", ".m2", ".cargo", "pkg",
    "jdk", "jre", "sdk", "runtime", "runtimes",
    "docs", "doc", "assets", "static", "public", "images", "fonts", "icons",
    "__snapshots__", "fixtures", "testdata", "test_data",
    "generated", "generated-src", "generated-sources", "gensrc", "gen-go", "gen-py", "gen-java", "gen-cpp",
]
TOOLKIT_PREFIXES = ["jdk-", "jdk1", "jdk2", "jre-", "jre1", "jre2", "sdk-", "dotnet", "python2", "python3", "go1.", "node-v", "graalvm", "openjdk"]
SYSTEM_PLACES = ["program files", "windows", "/usr/lib/", "/usr/local/lib/", "/usr/share/", "/opt/"]
KEPT_HIDDEN = [".github", ".gitlab", ".circleci", ".azure-pipelines"]
# Endings of files that are no text, and of texts that are no code.
BINARY_ENDINGS = ["exe", "dll", "so", "dylib", "a", "lib", "o", "obj", "class", "jar", "war", "ear", "pyc", "pyo", "pyd", "wasm", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "avi", "wav", "flac", "ogg", "webm", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "ttf", "otf", "woff", "woff2", "eot", "db", "sqlite", "sqlite3", "bin", "dat", "raw", "lock"]
TEXT_ENDINGS = ["md", "rst", "txt", "adoc", "csv", "tsv", "html", "htm", "css", "scss", "sass", "less", "proto", "graphql", "gql", "thrift", "avsc", "fbs", "tmpl", "tpl", "mustache", "hbs", "handlebars", "jinja", "jinja2", "j2", "ejs"]
# First bytes of files that are no text.
MAGIC = ["7F454C46", "4D5A", "CAFEBABE", "FEEDFA", "CFFAEDFE", "504B0304", "1F8B", "425A68", "FD377A585A", "89504E47", "FFD8FF", "47494638", "52494646", "00000100", "53514C69746520666F726D6174"]
# Names of files that a generator wrote, by ending; by the end of the stem and the ending; by a part of the name and the ending.
GENERATED_ENDINGS = [
    ".pb.go", ".pb.cc", ".pb.c", ".pb.h", ".pb.hpp", ".pb.m", ".pb.mm", ".pb.swift", ".pb.rs", ".pb.ts", ".pb.js", ".pb.gw.go",
    "_pb2.py", "_pb2.pyi", "_pb2_grpc.py", "-remote.go", "_types.go", ".swagger.json", "_generated.h", "_generated.go", "_generated.rs",
    ".generated.ts", ".generated.tsx", ".generated.js", ".graphql.ts", ".graphql.js",
]
GENERATED_STEMS, STEM_KINDS = ["_types", "_constants", "_service"], ["go", "py", "java", "cpp", "rb"]
GENERATED_PARTS, PART_KINDS = ["swagger-", "swagger_", "openapi-", "openapi_"], ["go", "py", "java", "ts"]
#: What may stand before a remark of one line.
_COMMENT = r"^[ \t]*(?://|#|/\*|\*|--|<!--|;|%|\(\*|\"\"\")"


def language(path: Column) -> Column:
    """Language of a path by its extension in any case; null for an unknown one."""
    names = F.create_map(*[F.lit(v) for name, kinds in EXTENSIONS.items() for e in kinds for v in (e, name)])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def language_order(name: Column) -> list[Column]:
    """Sort keys: tier, place in it, name; languages of no tier come last."""
    order = [x for tier in TIERS for x in tier]
    place = F.array_position(F.array(*map(F.lit, order)), name)
    return [F.when(place == 0, len(order) + 1).otherwise(place), name]


def _segment(pattern: str) -> str:
    """Java pattern of a glob within one path segment."""
    return fnmatch.translate(pattern).removesuffix("\\Z").removesuffix("\\z").replace("(?s:", "(?:", 1).replace(".*", "[^/]*")


def glob(path: Column, patterns: list[str]) -> Column:
    """Whether a path has a match: a pattern with glob signs by the whole path or its end, another by a segment, in any case."""

    def one(p: str) -> Column:
        if re.search(r"[*?\[]", p):
            whole = fnmatch.translate(p)
            return path.rlike(f"^(?:{whole})") | path.rlike(f"^(?:{fnmatch.translate('*/' + p)})")
        return F.array_contains(F.split(F.lower(path), "/"), p.strip("/").lower())

    return reduce(Column.__or__, map(one, patterns), F.lit(False))


def ignored_by_file(path: Column, rules: list[str]) -> Column:
    """Ignore-file rules: one with a slash matches the path or what lies below it, another any segment. Comments and negations have no effect."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule[0] in "#!":
            continue
        bare = rule.strip("/")
        if "/" in bare:
            out |= path.rlike(f"^(?:{fnmatch.translate(bare)})") | path.rlike(f"^(?:{fnmatch.translate(bare + '/*')})")
        else:
            out |= path.rlike(f"(?:^|/){_segment(bare)}(?:/|$)")
    return out


def skipped(path: Column) -> Column:
    """A path below a skipped, hidden or generated folder, a toolkit or a system's own place, or whose ending is no code; the folders of build services stay."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    named = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    toolkit = F.exists(folders, lambda f: reduce(Column.__or__, [f.startswith(p) for p in TOOLKIT_PREFIXES]) | f.endswith(".egg-info"))
    hidden = F.exists(folders, lambda f: f.startswith(".") & (f != ".") & ~f.isin(KEPT_HIDDEN))
    system = reduce(Column.__or__, [F.contains(F.concat(F.lit("/"), low), F.lit(p)) for p in SYSTEM_PLACES if p.startswith("/")]) | F.exists(folders, lambda f: f.isin("program files", "program files (x86)", "windows"))
    ending = F.regexp_extract(low, r"\.([^./]+)$", 1)
    return named | toolkit | hidden | system | ending.isin(BINARY_ENDINGS) | ending.isin(TEXT_ENDINGS)


def generated_name(path: Column) -> Column:
    """A name that generators give."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stem, kind = F.regexp_extract(name, r"^(.*)\.", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    any_of = lambda tests: reduce(Column.__or__, tests)
    by_stem = kind.isin(STEM_KINDS) & any_of([stem.endswith(e) for e in GENERATED_STEMS])
    by_part = kind.isin(PART_KINDS) & any_of([F.contains(name, F.lit(p)) for p in GENERATED_PARTS])
    return any_of([name.endswith(e) for e in GENERATED_ENDINGS]) | by_stem | by_part


def is_binary(content: Column) -> Column:
    """Known first bytes, or a NUL among the first 512."""
    head = F.hex(F.substring(content, 1, 512))
    return head.rlike("^(?:" + "|".join(MAGIC) + ")") | head.rlike("^(?:..)*?00")


def is_generated(text: Column) -> Column:
    """Whether a remark among the first 4096 characters says that a program wrote the file.

    A remark is a line that begins as a comment does. It says so if it opens with
    ``generated by`` or the like, if its subject is this code, file or class, if
    that went automatically, or with a marker, ``@generated`` or
    ``<auto-generated``. So do two remarks together, of which one forbids edits
    and one names the definition that the file comes from. An annotation of a
    class counts as a remark; what else a program may generate does not.
    """
    head = F.split(F.lower(F.substring(text, 1, 4096)), r"\r?\n")
    remarks = F.filter(head, lambda line: line.rlike(_COMMENT))
    opens = _COMMENT + r"[ \t*!-]*(?:auto)?generated[ :]+(?:by|from|with|using)\b"
    subject = r"\b(?:code|file|class|source|module) (?:(?:is|was|has been) )?generated\b"
    told = remarks_say(remarks, opens, subject, r"\b(?:automatically|auto)[ -]?generated\b", r"<auto-generated|@generated\b")
    annotated = F.exists(head, lambda line: line.rlike(r"^[ \t]*(?:@(?:\w+\.)*generated\b|\[(?:\w+\.)*generatedcode\b)"))
    locked = remarks_say(remarks, r"\b(?:do not|don't|must not|never) (?:be )?(?:edit|edited|modify|modified|change)\b")
    origin = remarks_say(remarks, r"\bsource\b.*\.(?:proto|thrift|graphql|idl)\b")
    return told | annotated | (locked & origin)


def remarks_say(remarks: Column, *patterns: str) -> Column:
    return F.exists(remarks, lambda line: reduce(Column.__or__, [line.rlike(p) for p in patterns]))


def decoded(content: Column, errors: str = "ignore") -> Column:
    """UTF-8 text: what is not UTF-8 is left out, or with ``replace`` becomes U+FFFD; a genuine U+FFFD stays."""
    if errors == "replace":
        return F.make_valid_utf8(content.cast("string"))
    mark = F.lit("\U0010fffe")  # no character: stands for genuine ones while the others go
    genuine = F.replace(content.cast("string"), F.lit("\ufffd"), mark)
    return F.replace(F.replace(F.make_valid_utf8(genuine), F.lit("\ufffd"), F.lit("")), mark, F.lit("\ufffd"))


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def ignore_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """The rules of the ignore file in a folder, in order; none without one. Spark's readers pass over hidden files, so it is opened by itself."""
    store, at = _store(spark, f"{root.rstrip('/')}/{name}")
    if not store.exists(at):
        return []
    stream = store.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [r.strip() for r in text.splitlines() if r.strip() and r.strip()[0] != "#"]


def _roots(spark: SparkSession, root: str) -> list[str]:
    """The folder, and the hidden folders of build services in it, which Spark's readers would pass over."""
    inside = [f"{root.rstrip('/')}/{name}" for name in KEPT_HIDDEN]
    return [root, *[p for p in inside if (at := _store(spark, p))[0].exists(at[1])]]


def _relative(root: str) -> Column:
    # the reader gives whole addresses; the part behind the root's own path is kept
    tail = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    return F.substring_index(F.col("path"), tail, -1) if tail != "/" else F.col("path")


def listing(spark: SparkSession, root: str, exclude: list[str] = (), ignore_rules: list[str] = (), only: list[str] = (), changed: DataFrame | None = None) -> DataFrame:
    """``path, lang, address, length`` of the files that ``scan`` would read; only names are looked at.

    Files whose own name begins with a dot are not listed, nor hidden folders but those of build services.

    ``changed`` (``path``) replaces the whole tree by the files that have changed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_roots(spark, root))
    rows = files.select(F.col("path").alias("address"), _relative(root).alias("path"), "length").withColumn("lang", language(F.col("path")))
    keep = rows.where(~skipped(F.col("path")) & ~generated_name(F.col("path")) & ~glob(F.col("path"), list(exclude)) & ~ignored_by_file(F.col("path"), list(ignore_rules)))
    if only:
        keep = keep.where(F.col("lang").isin(list(only)))
    if changed is not None:
        keep = keep.join(changed.select("path").distinct(), "path", "left_semi")
    return keep.select("path", "lang", "address", "length")


#: Addresses handed to one reader.
ADDRESSES = 20_000


def scan(spark: SparkSession, root: str, exclude: list[str] = (), ignore_rules: list[str] = (), only: list[str] = (), changed: DataFrame | None = None, errors: str = "ignore") -> DataFrame:
    """``path, lang, content`` of the text files below a folder of any store Spark reads; paths are relative to it.

    Skipped folders, excluded paths, binary and generated files are left out;
    ``only`` names languages to keep, ``changed`` (``path``) the files that
    have changed. Names are listed first and only kept files are opened, by their
    addresses, ``ADDRESSES`` a reader; like Spark's own file index the addresses
    pass the driver. For a mounted tree ``tree.scan`` lists in the cluster.
    """
    kept = listing(spark, root, exclude, ignore_rules, only, changed)
    found = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r.address) for r in kept.select("address").toLocalIterator()]
    if not found:
        return spark.createDataFrame([], "path string, lang string, content string")
    parts = [spark.read.format("binaryFile").load(found[at : at + ADDRESSES]) for at in range(0, len(found), ADDRESSES)]
    rows = reduce(DataFrame.unionAll, parts).select(_relative(root).alias("path"), "content")
    return texts(rows.withColumn("lang", language(F.col("path"))), errors)


def texts(rows: DataFrame, errors: str = "ignore") -> DataFrame:
    """``path, lang, content`` of ``path, lang, content`` as bytes, without binary and generated files."""
    return rows.where(~is_binary(F.col("content"))).select("path", "lang", decoded(F.col("content"), errors).alias("content")).where(~is_generated(F.col("content")))


def file_counts(files: DataFrame) -> DataFrame:
    """``lang, files``, and the number of all files, of unknown languages too, under ``total``."""
    each = files.where("lang is not null").groupBy("lang").agg(F.count("*").alias("files"))
    return each.unionByName(files.agg(F.count("*").alias("files")).select(F.lit("total").alias("lang"), "files"))


def package_of(path: Column, lang: Column) -> Column:
    """Module or package that a path stands for: dotted without source root and extension; Java's and Go's is the folder."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(clean, r"\.[^./]+$", "")
    plain = F.regexp_replace(bare, r"^(?:src|lib|source)/", "")
    python = F.regexp_replace(F.regexp_replace(plain, r"(?:^|/)__init__$", ""), "/", ".")
    below = F.regexp_replace(bare, r"^(?:src/main/java|src/test/java|src)/", "")
    java = F.when(F.contains(below, F.lit("/")), F.replace(F.regexp_replace(below, r"/[^/]*$", ""), F.lit("/"), F.lit("."))).otherwise(below)
    go = F.when(F.contains(clean, F.lit("/")), F.regexp_replace(clean, r"/[^/]*$", "")).otherwise("")
    return F.when(lang == "python", python).when(lang == "java", java).when(lang == "go", go).otherwise(F.replace(plain, F.lit("/"), F.lit(".")))
