"""Lookups and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metadata as M
from tessera.sources.bindings import COMMITS_SQL, FILES_SQL, LINES_SQL, SYMBOLS_SQL

F_ = f"WITH {FILES_SQL} "
L_ = f"WITH {LINES_SQL} "
S_ = f"WITH {SYMBOLS_SQL} "
_FILE = ["file_id", "path", "language", "size_bytes", "content_hash"]
_COLS = ", ".join(_FILE)


def _half(files, keep: int):
    return files.where(F.col("file_id") % 7 != keep).withColumn("content_hash", F.when(F.col("file_id") % 11 == keep, F.sha2(F.concat("text", F.lit(str(keep))), 256)).otherwise(F.col("content_hash"))).withColumn("path", F.when(F.col("file_id") % 13 == 5, F.concat("path", F.lit(f".v{keep}"))).otherwise(F.col("path")))


def _half_sql(name: str, keep: int) -> str:
    return f"{name} AS (SELECT CASE WHEN file_id % 13 = 5 THEN path || '.v{keep}' ELSE path END AS path, CASE WHEN file_id % 11 = {keep} THEN sha256(text || '{keep}') ELSE content_hash END AS content_hash FROM files WHERE file_id % 7 <> {keep})"


QUERIES = {
    "meta_list_files": (lambda t: M.list_files(t.files.select(*_FILE), 200, 50), F_ + f"SELECT {_COLS} FROM files ORDER BY path LIMIT 200 OFFSET 50"),
    "meta_file_by_path": (lambda t: M.file_by_path(t.files.select(*_FILE), "src8/28.en"), F_ + f"SELECT {_COLS} FROM files WHERE path = 'src8/28.en'"),
    "meta_all_files": (lambda t: t.files.select(*_FILE), F_ + f"SELECT {_COLS} FROM files"),
    "meta_symbols_like": (lambda t: M.list_symbols(t.symbols, "RED_w", 500), S_ + "SELECT * FROM symbols WHERE name ILIKE '%RED_w%' OR qualified_name ILIKE '%RED_w%' ORDER BY qualified_name, symbol_id LIMIT 500"),
    "meta_symbol_by_id": (lambda t: t.symbols.where("symbol_id = 17"), S_ + "SELECT * FROM symbols WHERE symbol_id = 17"),
    "meta_symbols_for_file": (lambda t: t.symbols.where("file_id = 5"), S_ + "SELECT * FROM symbols WHERE file_id = 5"),
    "meta_chunks": (lambda t: M.chunks(t.lines, 4), L_ + "SELECT file_id, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS text FROM lines GROUP BY file_id, (line - 1) // 4"),
    "meta_chunks_for_file": (lambda t: M.chunks(t.lines.where("file_id = 28"), 4), L_ + "SELECT file_id, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS text FROM lines WHERE file_id = 28 GROUP BY file_id, (line - 1) // 4"),
    "meta_chunks_containing": (lambda t: t.lines.where(M.like("text", "IDIOT")), L_ + "SELECT * FROM lines WHERE text ILIKE '%IDIOT%'"),
    "meta_symbol_chunks": (lambda t: M.symbol_chunks(t.lines, t.lines.where(F.col("text").rlike("^The ")).select("file_id", F.col("line").alias("symbol_id"), "line")), L_ + "SELECT s.file_id, s.line AS symbol_id, s.line AS start_line, coalesce(lead(s.line) OVER (PARTITION BY s.file_id ORDER BY s.line) - 1, l.last) AS end_line FROM lines s JOIN (SELECT file_id, max(line) AS last FROM lines GROUP BY 1) l USING (file_id) WHERE s.text LIKE 'The %'"),
    "meta_files_by_path_pattern": (lambda t: t.files.where(M.like("path", "SRC1_/")).select(*_FILE), F_ + f"SELECT {_COLS} FROM files WHERE path ILIKE '%SRC1_/%'"),
    "meta_tests_for_files": (lambda t: t.symbols.join(t.files.where("language = 'de'").select("file_id"), "file_id", "left_semi"), f"WITH {FILES_SQL}, {SYMBOLS_SQL} SELECT * FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE language = 'de')"),
    "meta_definition": (lambda t: M.definition(t.symbols, "red widget", ("ECONOMY", "SMALL")), S_ + "SELECT * FROM symbols WHERE name = 'red widget' OR ends_with(qualified_name, 'red widget') ORDER BY name <> 'red widget', CASE kind WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 ELSE 999 END, length(qualified_name), qualified_name, symbol_id LIMIT 1"),
    "meta_references": (lambda t: M.word_references(t.lines, "idiot"), L_ + "SELECT file_id, path, line FROM lines WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])idiot($|[^A-Za-z0-9_])')"),
    "meta_page_has_more": (lambda t: M.more(t.commits.select("commit_id", "author"), 100, 30, "commit_id"), f"WITH {COMMITS_SQL} SELECT commit_id, author, (SELECT count(*) FROM commits) > 130 AS has_more FROM commits ORDER BY commit_id LIMIT 100 OFFSET 30"),
    "meta_recent_commits": (lambda t: t.commits.orderBy(F.col("committed_at").desc(), "commit_id").limit(50).select("commit_id", "author", "summary"), f"WITH {COMMITS_SQL} SELECT commit_id, author, summary FROM commits ORDER BY committed_at DESC, commit_id LIMIT 50"),
    "meta_file_changes": (lambda t: M.file_changes(_half(t.files, 1), _half(t.files, 2)), F_ + f", {_half_sql('o', 1)}, {_half_sql('n', 2)} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.content_hash = n.content_hash THEN 'unchanged' WHEN o.path IS NOT NULL AND n.path IS NOT NULL THEN 'modified' WHEN n.path IS NULL THEN 'deleted' WHEN n.content_hash IN (SELECT content_hash FROM o WHERE path NOT IN (SELECT path FROM n)) THEN 'renamed' ELSE 'added' END AS change FROM o FULL JOIN n ON o.path = n.path"),
    "meta_language_counts": (lambda t: t.files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")), F_ + "SELECT language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY 1"),
    "meta_duplicate_contents": (lambda t: t.files.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1"), F_ + "SELECT content_hash, count(*) AS copies, min(path) AS first_path FROM files GROUP BY 1 HAVING count(*) > 1"),
}
