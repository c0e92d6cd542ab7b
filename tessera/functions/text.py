"""Tokens, identifiers, snippets and lexical scores as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalized(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else as spaces."""
    return ascii_lower(F.regexp_replace(c, "[^A-Za-z0-9]", " "))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def identifier_parts(c: Column) -> Column:
    """Lower-case parts, of two letters at least, of camelCase, ACRONYMWord and snake_case names."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(word_tokens(spaced), lambda t: F.length(t) >= 2)


def query_tokens(query: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), query)) if len(t) >= 2]


def split_identifier(name: str) -> list[str]:
    spaced = re.sub("([A-Z])(?=[A-Z][a-z])", r"\1 ", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", name))
    return [t.lower() for t in re.findall("[A-Za-z0-9]+", spaced) if len(t) >= 2]


def query_variants(query: str) -> list[str]:
    """The query; its words joined by OR, _ and -; its identifier parts joined by OR and spaces; sorted, each once."""
    out, tokens = {query}, [p for t in re.findall("[A-Za-z0-9]{2,}", query) for p in split_identifier(t)]
    if len(tokens) > 1:
        out |= {glue.join(tokens) for glue in (" OR ", "_", "-")}
    parts = split_identifier(query) if re.search("[_-]", query) or any(c.isupper() for c in query) else []
    if len(parts) > 1:
        out |= {" OR ".join(parts), " ".join(parts)}
    return sorted(out)


def occurrences(text: Column, phrase: str) -> Column:
    """How often the phrase occurs, occurrences not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def tokens_held(text: Column, tokens: list[str]) -> Column:
    out = F.lit(0)
    for t in tokens:
        out = out + F.when(text.contains(t), 1).otherwise(0)
    return out


def lexical_score(low: Column, query: str, generated: Column, vendor: Column, words_of: Column | None = None) -> Column:
    """0.35, 0.12 for each of up to five phrases and 0.08 for each of up to five words held; less for copied code. low: the
    text in lower case; words_of: its normal form. The numbers are fixed values."""
    phrases = occurrences(low, query.lower())
    words = tokens_held(normalized(low) if words_of is None else words_of, query_tokens(query))
    score = F.lit(0.35) + F.least(phrases, F.lit(5)) * 0.12 + F.least(words, F.lit(5)) * 0.08
    return score * F.when(generated, 0.55).otherwise(1.0) * F.when(vendor, 0.35).otherwise(1.0)


def snippet(text: Column, query: str, width: int = 240) -> Column:
    """The first line with the query, else the first that isn't blank, cut to width."""
    lines = F.split(text, "\n")
    hit = F.filter(lines, lambda x: ascii_lower(x).contains(query.lower()))
    full = F.filter(lines, lambda x: F.trim(x) != "")
    return F.left(F.trim(F.coalesce(F.get(hit, 0), F.get(full, 0), F.lit(""))), F.lit(width))


def fnv1a(token: Column) -> Column:
    """64-bit FNV-1a as DECIMAL(38,0): the offset basis and prime are fixed values of the hash."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(token, "utf-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    start, prime, whole = (F.lit(x).cast("decimal(38,0)") for x in ("14695981039346656037", "1099511628211", "18446744073709551616"))

    def step(h: Column, octet: Column) -> Column:
        low = (h % 256).cast("int")
        return ((h - low + low.bitwiseXOR(octet)) * prime % whole).cast("decimal(38,0)")

    return F.aggregate(octets, start, step)


def fnv1a_plain(token: str) -> int:
    """The same of a Python string, as a number."""
    h = 14695981039346656037
    for byte in token.encode():
        h = (h ^ byte) * 1099511628211 % 2**64
    return h
