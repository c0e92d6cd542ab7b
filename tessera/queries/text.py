"""Text retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.text import fnv1a, identifier_parts, snippet
from tessera.operators import search as S
from tessera.operators.ranking import best_per_path
from tessera.sources.bindings import FILES_SQL, LINES_SQL

TOKENS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
POSTINGS = f"tk AS (SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents), pt AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM tk), pp AS (SELECT doc_id, length, term, count(*) AS tf FROM pt GROUP BY ALL)"
BM25 = f"""{POSTINGS}, q AS (SELECT item_id AS query, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM pp GROUP BY 1), sz AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tk),
sc AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM pp JOIN q USING (term) JOIN df USING (term), sz GROUP BY 1, 2),
bm AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc)"""
NORM = "translate(regexp_replace({0}, '[^A-Za-z0-9]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
W = "path || ' ' || text"
SNIP = "left(trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: contains({low}, '{q}'))[1], list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')), 240)"
HITS = f"(length({LOW.format(W)}) - length(replace({LOW.format(W)}, 'of the', ''))) // 6"
HELD = f"(CASE WHEN contains({NORM.format(W)}, 'of') THEN 1 ELSE 0 END + CASE WHEN contains({NORM.format(W)}, 'the') THEN 1 ELSE 0 END)"


def _asked(t):
    return t.raw("benchmark").select(F.col("item_id").alias("query"), "text")


QUERIES = {
    "text_postings": (lambda t: S.postings(t.raw("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), f"WITH {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM pp GROUP BY 1"),
    "text_bm25": (lambda t: S.bm25(t.raw("documents"), "doc_id", "text", _asked(t)), f"WITH {BM25} SELECT * FROM bm WHERE rank <= 10"),
    "text_lexical": (lambda t: S.lexical(t.files, "path", "text", "of the"), f"WITH {FILES_SQL} SELECT path, round(0.35::DOUBLE + least({HITS}, 5) * 0.12::DOUBLE + least({HELD}, 5) * 0.08::DOUBLE, 6) AS score, {SNIP.format(low=LOW.format('x'), q='of the')} AS snippet FROM files WHERE contains({LOW.format(W)}, 'of the') OR (contains({NORM.format(W)}, 'of') AND contains({NORM.format(W)}, 'the'))"),
    "text_grep": (lambda t: S.grep(t.lines, r"[0-9]{3,}"), f"WITH {LINES_SQL} SELECT * FROM lines WHERE regexp_matches(text, '[0-9]{{3,}}')"),
    "text_snippet": (lambda t: t.files.select("file_id", snippet(F.col("text"), "and").alias("snippet")), f"WITH {FILES_SQL} SELECT file_id, {SNIP.format(low=LOW.format('x'), q='and')} AS snippet FROM files"),
    "text_identifier_parts": (lambda t: t.raw("pages").select("page_id", F.array_join(identifier_parts(F.col("url")), " ").alias("parts")), f"SELECT page_id, array_to_string(list_filter({TOKENS.format('regexp_replace(regexp_replace(url, ' + chr(39) + '([a-z0-9])([A-Z])' + chr(39) + ', ' + chr(39) + chr(92) + '1 ' + chr(92) + '2' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '([A-Z])([A-Z][a-z])' + chr(39) + ', ' + chr(39) + chr(92) + '1 ' + chr(92) + '2' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda x: length(x) >= 2), ' ') AS parts FROM pages"),
    "text_best_line_per_file": (lambda t: best_per_path(t.lines.where(F.col("text").contains("that")).withColumn("score", F.length("text")), "score", "line").select("path", "line", "score"), f"WITH {LINES_SQL} SELECT path, line, CAST(score AS INTEGER) AS score FROM (SELECT path, line, length(text) AS score, row_number() OVER (PARTITION BY path ORDER BY length(text) DESC, line) AS n FROM lines WHERE contains(text, 'that')) WHERE n = 1"),
    "text_endpoints": (lambda t: t.raw("pages").select("page_id", P.endpoint_path(F.col("url")).alias("endpoint")), "SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS endpoint FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS p FROM pages)"),
    "text_endpoint_counts": (lambda t: t.raw("pages").groupBy(P.parent(P.endpoint_path(F.col("url"))).alias("folder")).agg(F.count("*").alias("n")), "SELECT coalesce(regexp_extract(CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END, '^(.*)/[^/]*$', 1), '') AS folder, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS p FROM pages) GROUP BY 1"),
    "text_redact": (lambda t: t.lines.select("file_id", "line", P.redacted(F.col("text")).alias("redacted")).where("redacted LIKE '%[REDACTED]%'"), f"WITH {LINES_SQL} SELECT * FROM (SELECT file_id, line, regexp_replace(text, '([^\\s=]*(?:password|passwd|secret|token|api_?key)[^\\s=]*=)\\S+', '\\1[REDACTED]', 'gi') AS redacted FROM lines) WHERE redacted LIKE '%[REDACTED]%'"),
    "text_generated_files": (lambda t: t.files.where(P.is_generated(F.col("text"))).select("file_id"), f"WITH {FILES_SQL} SELECT file_id FROM files WHERE regexp_matches(lower(array_to_string(string_split(text, chr(10))[1:8], chr(10))), '@generated|code generated|do not edit|automatically generated')"),
    "text_fnv1a": (lambda t: t.raw("nation").select("n_name", fnv1a(F.col("n_name")).cast("string").alias("hash")), None),
}
