"""Content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(value: Column | str) -> Column:
    return F.sha2(F.col(value) if isinstance(value, str) else value, 256)


def edge_id(kind: str, source: str, target: str, salt: Column | None = None) -> Column:
    """`edge:` and the SHA-256 of type, ends and, if given, a salt, joined by colons."""
    parts = [F.col(kind), F.col(source), F.col(target), *([salt] if salt is not None else [])]
    return F.concat(F.lit("edge:"), stable_hash(F.concat_ws(":", *parts)))


def escape_component(value: Column) -> Column:
    """Percent signs, colons, slashes and control characters, which may not stand in a part of an id, written as escapes."""
    out = value
    for mark, escape in (("%", "%25"), (":", "%3A"), ("/", "%2F"), ("\\", "%5C")):
        out = F.replace(out, F.lit(mark), F.lit(escape))
    for code in (9, 10, 13):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def file_node_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), repo_path(path))


def symbol_node_id(symbol_id: Column) -> Column:
    return node_id("symbol", escape_component(symbol_id.cast("string")))


def route_node_id(protocol: Column, method: Column, path: Column) -> Column:
    method = F.coalesce(F.nullif(F.upper(F.trim(method)), F.lit("")), F.lit("*"))
    return node_id("route", *map(escape_component, (F.lower(F.trim(protocol)), method, normalize_route(path))))


def plain_node_id(kind: str, label: Column) -> Column:
    """Ids of configuration keys, resources, tests, runtime errors and components: the kind and the escaped label."""
    return node_id(kind, escape_component(F.trim(label)))


def normalize_route(path: Column) -> Column:
    """Trimmed, with a leading slash."""
    bare = F.trim(path)
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def repo_path(path: Column) -> Column:
    """A relative path with slashes, without empty and `.` parts; null for one that is absolute, empty or leads out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    return F.when(path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0), None).otherwise(F.array_join(parts, "/"))


def analysis_node_id(kind: Column, label: Column) -> Column:
    return node_id("analysis", kind, stable_hash(F.lower(label)))


def embedding_cache_key(target: Column, content: Column, model: str, dims: int) -> Column:
    return F.concat_ws(":", target.cast("string"), stable_hash(content), F.lit(model), F.lit(str(dims)))


def qualified_name(path: Column, language: Column, package: Column, name: Column) -> Column:
    """Parts joined by `::`: the package of Java and Go files that name one, else folders and file; then the name.

    Files that stand for their folder add no part, nor do the folders that Java sources lie in; a last part that is the
    name already isn't repeated.
    """
    parts = F.split(repo_path(path), "/")
    last = F.element_at(parts, -1)
    stem, ending = F.regexp_extract(last, r"^(.+?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))
    folder = ((language == "python") & (stem == "__init__")) | ((language == "rust") & (ending == "rs") & (stem == "mod"))
    folder = folder | (language.isin("typescript", "javascript") & ending.isin("ts", "tsx", "js", "jsx") & (stem == "index"))
    head = F.slice(parts, 1, F.size(parts) - 1)
    here = F.when(folder, head).otherwise(F.concat(head, F.array(stem)))
    sources = (language == "java") & F.array_join(F.slice(here, 1, 3), "/").isin("src/main/java", "src/test/java") & (F.size(here) >= 4)
    here = F.when(sources, F.slice(here, 4, 1000)).otherwise(here)
    java = F.concat(F.filter(F.split(package, r"\."), lambda x: x != ""), F.array(stem))
    here = F.when(package.isNotNull() & (language == "java"), java).when(package.isNotNull() & (language == "go"), F.array(package)).otherwise(here)
    return F.array_join(F.when(F.element_at(here, -1) == name, here).otherwise(F.concat(here, F.array(name))), "::")


def package_of_text(text: Column) -> Column:
    """What the first line that declares a package names."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^\s*package\s+([^\n;]+)", 1), ";$", "")), F.lit(""))


def endpoint_node_id(label: Column) -> Column:
    from tessera.functions.paths import endpoint

    e = endpoint(label)
    return route_node_id(e["protocol"], e["method"], e["path"])


def target_node_id(kind: Column, label: Column) -> Column:
    """The id of what a fact points to, by its kind."""
    out = analysis_node_id(F.regexp_replace(F.initcap(F.regexp_replace(kind, "_", " ")), " ", ""), label)
    for name, prefix in (("config_key", "config"), ("runtime_error", "runtime"), ("resource", "resource"), ("architecture_component", "architecture")):
        out = F.when(kind == name, plain_node_id(prefix, label)).otherwise(out)
    out = F.when(kind == "test", F.concat(F.lit("test:"), F.regexp_replace(label, r"[:/\\\\]", "_"))).otherwise(out)
    return F.when(kind == "file", F.coalesce(file_node_id(label), out)).when(kind == "endpoint", endpoint_node_id(label)).otherwise(out)
