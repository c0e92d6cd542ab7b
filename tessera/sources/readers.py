"""Files, logs, reports, owner files and policies as tables, and index tables written as versions."""

from __future__ import annotations

import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import paths as P
from tessera.operators import extract as E
from tessera.operators.ownership import OWNER_FILES, owner_rules
from tessera.operators.rules import glob_pattern

# Where runtime and validation artifacts lie, and how large files and lists may be.
RUNTIME_ROOTS = ("runtime", "traces", "logs")
REPORT_ROOTS = ("coverage", "target/site", "build/reports", "reports")
LARGEST_FILE = 1 << 20


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), most: int = LARGEST_FILE, fast: bool = False) -> DataFrame:
    """(path, size_bytes, skip, language, content_hash, generated, vendor, text) of all files below a folder.

    skip is why a file is left out, in this order: like a secret, hidden, excluded by a glob, copied, secondary (fast),
    too large; its content is then null. The folder lies on a disk that the executors
    share; names are listed once and contents read by executors, about 64 MB a task.
    """
    spark.dataSource.register(FileTree)
    rows = spark.read.format("file_tree").option("path", root).option("most", most).load()
    excluded = F.lit(False)
    for glob in exclude:
        excluded = excluded | F.col("path").rlike(glob_pattern(glob))
    c = F.col("path")
    skip = F.when(P.is_secret(c), "secret_like").when(c.rlike(r"(^|/)\."), "hidden").when(excluded, "excluded").when(P.is_vendor(c), "vendor")
    skip = (skip.when(P.is_secondary(c), "secondary") if fast else skip).when(F.col("size_bytes") > most, "too_large")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    kept = lambda x: F.when(F.col("skip").isNull(), x)
    return rows.withColumn("skip", skip).select("path", "size_bytes", "skip", kept(P.detect_language(c)).alias("language"), kept(F.sha2("content", 256)).alias("content_hash"), kept(P.is_generated(text)).alias("generated"), P.is_vendor(c).alias("vendor"), kept(text).alias("text"))


class FileTree(DataSource):
    """All files below a folder, dotted, underscored and empty ones too, which the built-in file sources leave out:
    options path and most, the size beyond which content is null."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, size_bytes long, content binary"

    def reader(self, schema) -> "FileTreeReader":
        return FileTreeReader(dict(self.options))


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"].removeprefix("file:"), int(options["most"])

    def partitions(self) -> list[InputPartition]:
        """Lists of names and sizes, each of some 64 MB or 4096 files."""
        parts, part, held = [], [], 0
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if f != ".git")
            for name in sorted(names):
                path = os.path.join(folder, name)
                if os.path.isfile(path) and not os.path.islink(path):
                    size = os.path.getsize(path)
                    part.append((os.path.relpath(path, self.root), size))
                    held += min(size, self.most)
                    if held >= 64 << 20 or len(part) >= 4096:
                        parts, part, held = [*parts, InputPartition(part)], [], 0
        return [*parts, InputPartition(part)]

    def read(self, partition):
        for path, size in partition.value:
            yield path, size, Path(self.root, path).read_bytes() if size <= self.most else None


def skip_counts(scanned: DataFrame) -> DataFrame:
    """(skip, n): files left out, by reason."""
    return scanned.where("skip IS NOT NULL").groupBy("skip").agg(F.count("*").alias("n"))


def build_systems(scanned: DataFrame) -> DataFrame:
    """(system): build systems that marker files at the top tell of."""
    return scanned.where(~F.col("path").contains("/")).select(P.build_system(F.col("path")).alias("system")).where("system IS NOT NULL").distinct()


class GitLog(DataSource):
    """Commits or changed hunks of a repository on a disk that the executors share: options path, commits (at most) and
    patches. A log is one stream, so it is one partition."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        touch = "struct<kind:string,path:string,previous:string>"
        hunk = "struct<path:string,old_start:int,old_end:int,new_start:int,new_end:int>"
        return f"commit_id string, author string, committed_at string, summary string, {'hunks array<' + hunk if self.options.get('patches') == 'true' else 'touches array<' + touch}>"

    def reader(self, schema) -> "GitLogReader":
        return GitLogReader(dict(self.options))


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        patches = self.options.get("patches") == "true"
        what = ["-p", "-U0", "--no-ext-diff"] if patches else ["--name-status", "-M"]
        command = ["git", "-C", self.options["path"], "log", f"-{int(self.options.get('commits', 1000))}", "--format=%x1e%H%x1f%an%x1f%cI%x1f%s", *what]
        raw = subprocess.run(command, capture_output=True, check=True).stdout.decode(errors="replace")
        for record in filter(str.strip, raw.split("\x1e")):
            head, _, body = record.partition("\n")
            commit = next(E.commits("\x1e" + head))
            if patches:
                ends = lambda r: r or (None, None)
                found = [(h["path"], *ends(h["old"]), *ends(h["new"])) for h in E.hunks(body)]
            else:
                found = [(t["kind"], t["path"], t["previous"]) for t in E.name_status(body.strip("\n"))]
            yield commit["commit_id"], commit["author"], commit["committed_at"], commit["summary"], found


def git_log(spark: SparkSession, path: str, commits: int = 1000, patches: bool = False) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("path", path).option("commits", commits).option("patches", str(patches).lower()).load()


def runtime_lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(record, value): JSON lines of artifacts; record is unique, not gapless."""
    return spark.read.text(folders, recursiveFileLookup=True).select(F.monotonically_increasing_id().alias("record"), "value")


def reports(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """(report, text): whole report files whose names match a glob."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folders, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"))


def owners_of(spark: SparkSession, root: str) -> list[tuple[str, list[str]]]:
    """Rules of the owner files of a repository, in the order in which these are looked for."""
    out = []
    for name in OWNER_FILES:
        try:
            out += owner_rules(spark.read.text(f"{root}/{name}", wholetext=True).first().value)
        except Exception as e:  # noqa: BLE001  there is no such file
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def policy(text: str) -> dict:
    """An architecture policy from its TOML: components (id, globs), dependencies (from, to, action), public APIs and
    exemptions, or an error that names what is wrong."""
    raw = tomllib.loads(text)
    components = {c["id"]: list(c["globs"]) for c in raw.get("components", [])}
    rules = [(r["from"], r["to"], r.get("action", "forbid")) for r in raw.get("dependencies", [])]
    wrong = [f"unknown component {x}" for a, b, _ in rules for x in (a, b) if x != "*" and x not in components]
    wrong += [f"unknown action {action}" for _, _, action in rules if action not in ("allow", "forbid")]
    wrong += [f"component without globs: {k}" for k, globs in components.items() if not globs]
    if wrong:
        raise ValueError("; ".join(wrong))
    apis = [(a["id"], a["component"], a.get("reason", ""), list(a.get("public", [])), list(a.get("internal", []))) for a in raw.get("public_api", [])]
    return {"components": [(k, g) for k, globs in components.items() for g in globs], "rules": rules, "public_api": apis, "exemptions": raw.get("exemptions", [])}


def save_index(tables: dict[str, DataFrame], folder: str, version: int, schema_version: int = 1) -> None:
    """Writes record tables as a version of their own; a manifest, written last, makes it the one that load_index() finds."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(version, schema_version, name, tables[name].schema.json()) for name in tables]
    spark.createDataFrame(rows, "version int, schema_version int, name string, schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifests/v{version}")


def load_index(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version with a manifest, or of the one asked for."""
    manifests = spark.read.schema("version int, schema_version int, name string, schema string").json(f"{folder}/manifests/*")
    wanted = version if version is not None else manifests.agg(F.max("version")).first()[0]
    return {r.name: spark.read.parquet(f"{folder}/v{wanted}/{r.name}") for r in manifests.where(F.col("version") == wanted).collect()}


def partial_update(previous: tuple[int, str] | None, following: tuple[int, str]) -> bool:
    """Whether an index may be brought up to date file by file: the same schema version and mode as before."""
    return previous is not None and previous == following


def replace_files(old: dict[str, DataFrame], new: dict[str, DataFrame], changed: DataFrame, folder: str, version: int) -> None:
    """A new version of all tables in which the rows of changed files (file_id) are those of `new`."""
    save_index({name: df.join(changed, "file_id", "left_anti").unionByName(new[name], allowMissingColumns=True) if name in new else df for name, df in old.items()}, folder, version)
