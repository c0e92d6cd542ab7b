"""Identifiers, anchors and names: normal forms, terms and what they match, as columns or, for a query's text, as lists."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path words that name no subject, names too common to search for, words of code that are no names.
STRUCTURAL = ("crates", "src", "lib", "main", "mod", "index")
GENERIC = (
    "", "args", "cli", "command", "commands", "config", "from", "helpers", "index", "lib", "main", "mod", "output", "path", "repo", "run",
    "test", "tests", "to", "types", "utils",
)
KEYWORDS = (
    "if", "else", "for", "while", "loop", "match", "return", "let", "const", "var", "function", "fn", "class", "struct", "enum", "trait",
    "interface", "impl", "pub", "private", "protected", "public", "static", "new", "true", "false", "null", "None", "Some", "Ok", "Err", "self",
    "this", "super", "crate", "import", "from", "use", "package",
)
# A task's words that stand for others, and words that tell what a task is about.
ALIASES = {"configuration": "config", "configurations": "config", "configured": "config", "configuring": "config", "defaults": "default", "histories": "history"}
CHANGE_WORDS = ("fix", "add", "change", "implement")
PATH_ENDINGS = (".rs", ".ts", ".tsx", ".js", ".jsx", ".java", ".py", ".go", ".md")
# Modules that come with a language.
BUILTINS = {
    "rust": ("std", "core", "alloc"),
    "javascript": ("fs", "path", "url", "http", "https", "crypto", "os", "stream"),
    "python": ("os", "sys", "pathlib", "json", "typing", "asyncio", "datetime"),
}


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def normalized_identifier(c: Column) -> Column:
    """Words of camelCase, snake_case, kebab-case and paths, in lower case with single spaces between."""
    humps = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.trim(F.lower(F.regexp_replace(humps, r"[^A-Za-z0-9]+", " ")))


def identifier_words(value: str) -> list[str]:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", value).lower().translate({i: " " for i in range(128) if not chr(i).isalnum()}).split()


def identifier_terms(c: Column) -> Column:
    """Words of three letters at least."""
    return F.filter(F.split(normalized_identifier(c), " "), lambda t: F.length(t) >= 3)


def terms_match(left: Column, right: Column) -> Column:
    """Equal, or one begins with the other if that has six letters at least."""
    return (left == right) | ((F.length(left) >= 6) & right.startswith(left)) | ((F.length(right) >= 6) & left.startswith(right))


def query_matches_path(query: Column, path: Column) -> Column:
    """Whether a word of the path that names a subject matches a word of the query."""
    subjects = F.filter(identifier_terms(path), lambda t: ~t.isin(*STRUCTURAL))
    return F.exists(subjects, lambda p: F.exists(identifier_terms(query), lambda q: terms_match(q, p)))


def query_identifiers(c: Column) -> Column:
    """The whole query and its tokens of three letters at least, as identifiers, each once."""
    tokens = F.transform(F.split(c, "[^A-Za-z0-9_-]"), normalized_identifier)
    whole = F.filter(F.array(normalized_identifier(c)), lambda t: t != "")
    return F.array_distinct(F.concat(whole, F.filter(tokens, lambda t: F.length(t) >= 3)))


def contains_anchor(haystack: Column, anchor: Column) -> Column:
    """Whether the lower-case text holds the anchor as it is or as words."""
    return haystack.contains(F.lower(anchor)) | haystack.contains(normalized_identifier(anchor))


def is_ticket(c: Column) -> Column:
    return c.rlike("^[A-Z]{2,}-[0-9]{2,}$")


def is_path_like(c: Column) -> Column:
    return c.contains("/") | any_of(c.endswith(e) for e in PATH_ENDINGS)


def is_named(c: Column) -> Column:
    """Whether a token looks like a name someone gave: mixed case, a separator, or digits beside capitals; tickets aren't."""
    mixed = c.rlike("[a-z]") & c.rlike("[A-Z]")
    return (F.length(c) >= 3) & ~is_ticket(c) & (mixed | c.rlike("[_-]") | (c.rlike("[0-9]") & c.rlike("[A-Z]")))


def named_identifiers(c: Column) -> Column:
    """The names in a text, each once, in order."""
    tokens = F.transform(F.split(c, "[^A-Za-z0-9_-]"), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    return F.array_distinct(F.filter(tokens, is_named))


def alias_terms(task: str) -> list[str]:
    """What a task's words stand for, and pairs of words of which one does."""
    words = [w for w in re.findall("[a-z0-9]+", task.lower()) if len(w) >= 3]
    meant = [ALIASES.get(w, w) for w in words]
    pairs = [" ".join(b) for a, b in zip(zip(words, words[1:]), zip(meant, meant[1:])) if a != b]
    return list(dict.fromkeys([b for a, b in zip(words, meant) if a != b] + pairs))


def intent(c: Column) -> Column:
    """code_change, validation or understanding."""
    low = F.lower(c)
    return F.when(any_of(low.contains(w) for w in CHANGE_WORDS), "code_change").when(low.contains("test"), "validation").otherwise("understanding")


def path_tokens(c: Column) -> Column:
    """Up to eight words of four letters at least."""
    return F.slice(F.filter(F.split(c, "[^A-Za-z0-9_]"), lambda t: F.length(t) >= 4), 1, 8)


def is_generic(c: Column) -> Column:
    return F.lower(c).isin(*GENERIC)


def is_keyword(c: Column) -> Column:
    return c.isin(*KEYWORDS)


def module_of(qualified_name: Column) -> Column:
    """The qualified name without its last part; empty where it has one part."""
    return F.when(qualified_name.contains("::"), F.regexp_replace(qualified_name, "::(?:(?!::).)*$", "")).otherwise("")


def package_of(imported: Column) -> Column:
    """The first part of an import, or the first two of a scoped one."""
    return F.when(imported.startswith("@"), F.regexp_extract(imported, "^[^/]*(?:/[^/]*)?", 0)).otherwise(F.regexp_extract(imported, "^[^/]*", 0))


def last_part(imported: Column) -> Column:
    """What stands after the last slash, dot or colon of an import, without marks at its ends."""
    return F.regexp_replace(F.regexp_extract(imported, r"[^/.:]*$", 0), r"^[^\p{L}\p{N}_$]+|[^\p{L}\p{N}_$]+$", "")


def alias_capture(pattern: str, imported: Column) -> Column:
    """What the * of a pattern stands for in an import that the pattern holds, empty for a pattern without one, else null.
    An import that begins as the pattern does but ends otherwise gives all that follows."""
    before, star, after = pattern.partition("*")
    if not star:
        return F.when(imported == pattern, "")
    rest = F.substr(imported, F.lit(len(before) + 1))
    inner = F.when(rest.endswith(after), F.left(rest, F.length(rest) - len(after))) if after else rest
    return F.when(imported.startswith(before), F.coalesce(inner, rest))


def is_builtin(language: Column, imported: Column) -> Column:
    first = lambda by: F.regexp_extract(imported, f"^[^{by}]*", 0)
    js = F.when(imported.startswith("node:"), F.substr(imported, F.lit(6))).otherwise(imported)
    return (
        F.when(language == "rust", first(":").isin(*BUILTINS["rust"]))
        .when(language.isin("javascript", "typescript"), js.isin(*BUILTINS["javascript"]))
        .when(language == "python", first(".").isin(*BUILTINS["python"]))
        .when(language == "go", ~imported.contains(".") & ~imported.rlike("^/|//|/$|^$"))
        .when(language == "java", imported.startswith("java.") | imported.startswith("javax."))
        .otherwise(False)
    )


def short_name(qualified_name: Column) -> Column:
    """What follows the last :: and then the last dot."""
    return F.regexp_extract(F.regexp_extract(qualified_name, r"(?:.*::)?(.*)$", 1), r"[^.]*$", 0)
