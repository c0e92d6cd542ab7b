"""Predicates and normal forms of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension; marks of generated files; folders of copied or secondary code.
LANGUAGES = {"rs": "rust", "py": "python", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "tf": "terraform", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "sql": "sql", "sh": "shell"}
KNOWN_LANGUAGES = {
    "rs": "rust", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "tf": "text", "tfvars": "text", "hcl": "text", "sql": "sql",
    "md": "markdown", "mdx": "markdown", "txt": "text",
}
GENERATED_MARKS = ("@generated", "code generated", "automatically generated", "do not edit")
SECONDARY = ("docs", "doc", "examples", "example", "testdata", "fixtures", "fixture", "samples", "sample", "generated", "vendor", "third_party")
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "HTTP")
OTHER_PROTOCOLS = ("TCP", "UDP", "GRAPHQL", "GRPC", "TRPC")
BUILD_FILES = {
    "settings.gradle": "gradle", "settings.gradle.kts": "gradle", "build.gradle": "gradle", "build.gradle.kts": "gradle", "pom.xml": "maven",
    "WORKSPACE": "bazel", "WORKSPACE.bazel": "bazel", "MODULE.bazel": "bazel", "Cargo.toml": "cargo", "package.json": "npm", "go.mod": "go",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(F.lower(path).rlike(r"(^|/)dockerfile$"), "dockerfile").otherwise(F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown")))


def detect_language(path: Column) -> Column:
    """One of the known languages, by the file's extension as it is written; Dockerfiles are text."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    known = F.create_map(*[F.lit(x) for pair in KNOWN_LANGUAGES.items() for x in pair])
    return F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "text").otherwise(F.coalesce(F.try_element_at(known, F.regexp_extract(name, r".\.([^.]+)$", 1)), F.lit("unknown")))


def is_test(path: Column) -> Column:
    """Paths under test folders, and files named as tests are in some languages."""
    return F.lower(path).rlike(r"/tests?/|^tests/|(_test\.(rs|go|py)|test\.java|\.(spec|test)\.ts)$")


def is_vendor(path: Column) -> Column:
    return path.rlike(r"node_modules/|(^|/)(target|vendor|\.venv|dist|build)/")


def is_secondary(path: Column) -> Column:
    """What a fast index leaves out: documentation, examples, fixtures, copied and generated code."""
    return F.exists(F.split(F.lower(path), "/"), lambda x: x.isin(*SECONDARY) | x.contains(".generated."))


def build_system(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BUILD_FILES.items() for x in pair])
    return F.try_element_at(known, F.regexp_extract(path, r"[^/]*$", 0))


def is_generated(text: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 8), "\n"))
    out = F.lit(False)
    for mark in GENERATED_MARKS:
        out = out | head.contains(mark)
    return out


def is_secret(path: Column) -> Column:
    """A part of the path that is named like credentials or keys."""
    return F.lower(path).rlike(r"(^|/)(\.env(\.[^/]*)?|\.aws|\.ssh|[^/]*_key|[^/]*\.(pem|key))(/|$)|secret|credential")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^/.]*)?$", 1)


def endpoint_path(url: Column) -> Column:
    """Path of a URL or path: without quotes around it, query, fragment, scheme and host, with a leading slash or colon."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), '^"+|"+$', ""), "^'+|'+$", ""), "[?#].*$", "")
    bare = F.regexp_replace(bare, r"^.*?://[^/]*", "")
    return F.when(bare.rlike("^[/:]"), bare).otherwise(F.concat(F.lit("/"), bare))


def endpoint(label: Column) -> Column:
    """(protocol, method, raw, path) of a label such as `GET /x`; HTTP without a method has none."""
    text = F.trim(label)
    head, tail = F.upper(F.regexp_extract(text, r"^(\S*) ", 1)), F.trim(F.regexp_replace(text, r"^\S* ", ""))
    http, other = head.isin(*HTTP_METHODS), head.isin(*OTHER_PROTOCOLS)
    raw = F.when(http | other, tail).otherwise(text)
    method = F.when(http & (head != "HTTP"), head)
    return F.struct(F.when(other, F.lower(head)).otherwise("http").alias("protocol"), method.alias("method"), raw.alias("raw"), endpoint_path(raw).alias("path"))


def redacted(message: Column) -> Column:
    return F.regexp_replace(message, r"(?i)([^\s=]*(?:password|passwd|secret|token|api_?key)[^\s=]*=)\S+", "$1[REDACTED]")


def sql_table(statement: Column) -> Column:
    """The name after the first of FROM, JOIN, UPDATE, INTO that occurs, in that order of words."""
    found = [F.nullif(F.regexp_extract(statement, rf"(?i)\b{w}\s+([A-Za-z0-9_.]+)", 1), F.lit("")) for w in ("from", "join", "update", "into")]
    return F.coalesce(*found)


def compact_message(message: Column, width: int = 160) -> Column:
    """Redacted, trimmed and cut; null where nothing is left."""
    return F.nullif(F.left(F.trim(redacted(message)), F.lit(width)), F.lit(""))


def suffix_match(path: Column, reported: Column) -> Column:
    """Whether a report's path and a repository's are one, as far as the shorter of them goes."""
    a, b = F.lower(path), F.lower(reported)
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(a)


def same_parent(left: Column, right: Column) -> Column:
    return parent(left) == parent(right)


def byte_size(value: str) -> int:
    """Bytes of a size such as 512kb or 1 mb."""
    import re

    found = re.fullmatch(r"\s*(\d+)\s*(?:(b)?|([kmg])i?b)\s*", value.lower())
    if not found:
        raise ValueError(f"no size: {value}")
    return int(found[1]) * 1024 ** " kmg".index(found[3] or " ")


def truncated(text: str, most: int) -> tuple[str, bool]:
    """The text cut to so many bytes of UTF-8 at a letter's end, and whether it was cut."""
    data = text.encode()
    return (text, False) if len(data) <= most else (data[:most].decode(errors="ignore"), True)
