"""Lookups, searches and pages of the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import page

# Fixed values of paging.
DEFAULT_LIMIT, MOST_LIMIT, MOST_OFFSET = 20, 100, 10_000


def clamp(limit: int | None, offset: int | None = None) -> tuple[int, int]:
    return min(limit if limit is not None else DEFAULT_LIMIT, MOST_LIMIT), min(offset or 0, MOST_OFFSET)


def list_files(files: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    return page(files, limit, offset, "path")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def like(column: str, text: str) -> Column:
    """Substring, without regard to case; % and _ in the text are wildcards."""
    return F.col(column).ilike(f"%{text}%")


def list_symbols(symbols: DataFrame, text: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    found = symbols.where(like("name", text) | like("qualified_name", text)) if text else symbols
    return page(found, limit, offset, "qualified_name", "symbol_id")


def chunks(lines: DataFrame, height: int = 80) -> DataFrame:
    """(file_id, start_line, end_line, text): runs of `height` lines of each file."""
    at = F.floor((F.col("line") - 1) / height)
    runs = lines.groupBy("file_id", at.alias("run")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return runs.select("file_id", "start_line", "end_line", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def symbol_chunks(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file_id, symbol_id, start_line, end_line): each symbol's lines up to the next symbol's of the file (file_id, symbol_id, line)."""
    last = lines.groupBy("file_id").agg(F.max("line").alias("last"))
    order = Window.partitionBy("file_id").orderBy("line", "symbol_id")
    return starts.withColumn("next", F.lead("line").over(order)).join(last, "file_id").select("file_id", "symbol_id", F.col("line").alias("start_line"), F.coalesce(F.col("next") - 1, "last").alias("end_line"))


def definition(symbols: DataFrame, name: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The likeliest definition of a name: exact before qualified, kinds in order, then the shortest qualified name."""
    exact, tail = F.col("name") == name, F.col("qualified_name").endswith(name)
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) if kinds else F.lit(0), F.lit(0))
    return symbols.where(exact | tail).orderBy(F.when(exact, 0).otherwise(1), F.when(kind == 0, 999).otherwise(kind), F.length("qualified_name"), "qualified_name", "symbol_id").limit(1)


def word_references(lines: DataFrame, word: str) -> DataFrame:
    """(file_id, path, line): lines that hold the word with no word character next to it."""
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in word)
    return lines.where(F.col("text").contains(word) & F.col("text").rlike(rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")).select("file_id", "path", "line")


def more(df: DataFrame, limit: int, offset: int, *order: str) -> DataFrame:
    """A page with has_more on each row, from one row more than asked for."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("_n") <= limit).drop("_n")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): unchanged, modified, added, deleted or renamed (deleted there, added here with the same content)."""
    both = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("now")), "path", "full_outer")
    moved_from = both.where("now IS NULL").select(F.col("was").alias("hash")).distinct().withColumn("moved", F.lit(True))
    kind = F.when(F.col("was") == F.col("now"), "unchanged").when(F.col("was").isNotNull() & F.col("now").isNotNull(), "modified").when(F.col("now").isNull(), "deleted").when(F.col("moved"), "renamed").otherwise("added")
    return both.join(moved_from, (both.now == moved_from.hash) & both.was.isNull(), "left").select("path", kind.alias("change"))
