"""Runtime records from JSON lines, coverage and test results from reports, and the facts that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.functions.paths import compact_message, sql_table, suffix_match

# Under which names records carry what they say, the first that is there counts.
NAMES = {
    "file": ("file", "code.filepath", "source.file", "code.file.path", "source.path"),
    "symbol": ("symbol", "code.function", "function", "name"),
    "status": ("http.response.status_code", "http.status_code", "status_code", "status"),
    "error": ("error", "error.flag", "exception", "failed"),
    "failure": ("error.message", "exception.message", "span.status.message", "failure.message"),
    "line": ("line", "code.lineno", "source.line"),
    "service": ("service", "service.name", "service_name"),
    "route": ("http.route", "http.target", "url.path", "route", "span.name"),
    "method": ("http.request.method", "http.method", "method", "request.method"),
    "millis": ("duration_ms", "duration.ms", "http.server.duration", "elapsed_ms", "latency_ms"),
    "nanos": ("duration", "duration_ns"),
    "time": ("timestamp", "time", "@timestamp", "observed_at", "start_time"),
    "sql": ("db.statement", "sql", "database.statement"),
    "message": ("error.message", "exception.message", "log.message", "message", "event.message", "span.status.message", "failure.message"),
}
STALE_DAYS = 30


def _at(record: Column, key: str, under: str = "") -> Column:
    """The value of a key as it is written, else of its parts one below the other; record is parsed once, as a variant."""
    nested = "".join(f"['{part}']" for part in key.split("."))
    scalar = lambda path: F.try_variant_get(record, path, "string")
    found = F.coalesce(scalar(f"${under}['{key}']"), scalar(f"${under}{nested}")) if "." in key else scalar(f"${under}['{key}']")
    return F.when(~found.rlike(r"^\s*[\[{]"), found)


def json_text(record: Column, keys, places=("", "['attributes']", "['resource']['attributes']")) -> Column:
    return F.coalesce(*[_at(record, k, p) for k in keys for p in places])


def json_number(record: Column, keys, kind: str = "double") -> Column:
    return F.coalesce(*[_at(record, k, p).try_cast(kind) for k in keys for p in ("", "['attributes']")])


def json_flag(record: Column, keys) -> Column:
    low = lambda k: F.lower(_at(record, k))
    return F.coalesce(*[F.when(low(k).isin("true", "1", "yes"), True).when(low(k).isin("false", "0", "no"), False) for k in keys])


def report_path(path: Column, root: str = "") -> Column:
    """A path as the repository has it: without the root, `./` and backslashes."""
    inner = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path) if root else path
    return F.replace(F.regexp_replace(inner, r"^(\./)+", ""), F.lit("\\"), F.lit("/"))


def runtime_records(lines: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(record, path, symbol, line, service, route, method, status, duration_ms, error, time, sql, message) of JSON lines
    (record, value) whose file is one of files (path). Lines that are no objects give nothing. An error is a flag, a status
    of 500 or more, or a failure's message. Durations of a million and more without a unit are nanoseconds."""
    v = F.col("_v")
    rows = lines.where(F.trim("value").startswith("{")).withColumn("_v", F.try_parse_json("value")).where("_v IS NOT NULL")
    status, nanos = json_number(v, NAMES["status"], "int"), json_number(v, NAMES["nanos"])
    route = json_text(v, NAMES["route"])
    error = F.coalesce(json_flag(v, NAMES["error"]), F.lit(False)) | F.coalesce(status >= 500, F.lit(False)) | json_text(v, NAMES["failure"]).isNotNull()
    out = rows.select(
        "record", report_path(json_text(v, NAMES["file"]), root).alias("path"), json_text(v, NAMES["symbol"]).alias("symbol"), json_number(v, NAMES["line"], "int").alias("line"),
        json_text(v, NAMES["service"]).alias("service"), F.when(route.contains("/"), route).alias("route"), F.upper(json_text(v, NAMES["method"])).alias("method"), status.alias("status"),
        F.coalesce(json_number(v, NAMES["millis"]), F.when(nanos > 1e6, nanos / 1e6).otherwise(nanos)).alias("duration_ms"), error.alias("error"), json_text(v, NAMES["time"]).alias("time"),
        json_text(v, NAMES["sql"]).alias("sql"), compact_message(json_text(v, NAMES["message"])).alias("message"),
    )
    return out.join(files.select("path").distinct(), "path", "left_semi")


def record_facts(records: DataFrame) -> DataFrame:
    """(record, path, edge_type, target_kind, target, fact_id): the endpoint, table and error that a record names."""
    route = F.concat_ws(" ", F.coalesce("method", F.lit("HTTP")), "route")
    made = [("EXPOSES_ENDPOINT", "endpoint", F.when(F.col("route").isNotNull(), route)), ("READS_TABLE", "database_table", sql_table(F.col("sql"))), ("FAILED_IN", "runtime_error", F.col("message"))]
    each = F.array(*[F.struct(F.lit(e).alias("edge_type"), F.lit(k).alias("target_kind"), t.alias("target")) for e, k, t in made])
    rows = records.select("record", "path", F.explode(each).alias("f")).select("record", "path", "f.*").where("target IS NOT NULL")
    return rows.withColumn("fact_id", I.stable_hash(F.concat_ws(":", F.lit("runtime"), "path", "edge_type", "target", F.col("record").cast("string"))))


def record_groups(records: DataFrame) -> DataFrame:
    """(kind, path, target, count, errors, p50, p95, p99, services, statuses, first, last, confidence): what records of one
    endpoint, table, error or symbol of a file add up to; a record counts in each group that it names."""
    targets = {"route": F.when(F.col("route").isNotNull(), F.concat_ws(" ", F.coalesce("method", F.lit("HTTP")), "route")), "table": sql_table(F.col("sql")), "error": F.col("message"), "symbol": F.col("symbol")}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("target")) for k, t in targets.items()])
    d = F.col("duration_ms")
    rows = records.withColumn("_g", F.explode(each)).where("_g.target IS NOT NULL").withColumn("_d", F.when((d >= 0) & (d < float("inf")), d))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _d)")
    return rows.groupBy("_g.kind", "path", "_g.target").agg(
        F.count("*").alias("count"), F.sum(F.col("error").cast("long")).alias("errors"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
        F.array_join(F.array_sort(F.collect_set("service")), "|").alias("services"), F.array_join(F.transform(F.array_sort(F.collect_set("status")), lambda x: x.cast("string")), "|").alias("statuses"),
        F.min("time").alias("first"), F.max("time").alias("last"), F.when(F.count("*") >= 3, "high").otherwise("medium").alias("confidence"),
    )


def group_message(now: Column) -> Column:
    """What a row of record_groups() says, in words."""
    number = lambda name: F.when(F.col(name).isNotNull(), F.format_string(f", {name}_ms %.1f", F.col(name)))
    old = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp("last")) > STALE_DAYS * 86_400_000_000
    said = lambda name, label: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f", {label} "), F.col(name)))
    head = F.format_string("runtime aggregate observed: count %d, error_count %d, error_rate %.2f", F.col("count"), F.col("errors"), F.col("errors") / F.col("count"))
    fresh = F.when(F.try_to_timestamp("last").isNotNull(), F.when(old, ", freshness stale").otherwise(", freshness recent"))
    return F.concat_ws("", head, number("p50"), number("p95"), number("p99"), said("first", "first_observed"), said("last", "last_observed"), fresh, said("services", "services"), said("statuses", "status_codes"))


def coverage_json(reports: DataFrame) -> DataFrame:
    """(report, path, line): executed lines of JSON reports (report, text)."""
    files = F.from_json("text", "files map<string, struct<executed_lines: array<int>>>")["files"]
    return reports.select("report", F.explode(files).alias("path", "f")).select("report", "path", F.explode(F.array_distinct("f.executed_lines")).alias("line"))


def _parts(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}\b[^>]*?(?:/>|>.*?</{tag}>)"), F.lit(0))


def coverage_xml(reports: DataFrame) -> DataFrame:
    """(report, path, line): covered lines of XML reports (report, text): classes with a file name, and source files in
    packages. Each class or file is a small document of its own, so a report's size is no matter."""
    classes = reports.select("report", F.explode(_parts(F.col("text"), "class")).alias("x"))
    hits = lambda path: F.expr(f"xpath(x, '{path}')")
    a = classes.select("report", F.expr("xpath_string(x, '/class/@filename')").alias("path"), F.explode(F.concat(hits("//line[@hits>0]/@number"), hits("//line[not(@hits) and @ci>0]/@nr"))).alias("line"))
    packages = reports.select("report", F.explode(_parts(F.col("text"), "package")).alias("p")).withColumn("folder", F.replace(F.regexp_extract("p", r'^<package[^>]*?\sname="([^"]*)"', 1), F.lit("."), F.lit("/")))
    files = packages.select("report", "folder", F.explode(_parts(F.col("p"), "sourcefile")).alias("x"))
    name = F.expr("xpath_string(x, '/sourcefile/@name')")
    b = files.select("report", F.when(F.col("folder") == "", name).otherwise(F.concat_ws("/", "folder", name)).alias("path"), F.explode(hits("//line[@ci>0]/@nr")).alias("line"))
    return a.unionByName(b).select("report", "path", F.col("line").cast("int").alias("line")).where("path <> ''").distinct()


def junit_cases(reports: DataFrame) -> DataFrame:
    """(report, name, classname, file, status, seconds, line, message) of the test cases of reports (report, text)."""
    cases = reports.select("report", F.explode(_parts(F.col("text"), "testcase")).alias("x"))
    value = lambda path: F.nullif(F.expr(f"xpath_string(x, '/testcase/{path}')"), F.lit(""))
    has = lambda tag: F.expr(f"xpath_boolean(x, 'boolean(/testcase/{tag})')")
    status = F.when(has("failure"), "failed").when(has("error"), "error").when(has("skipped"), "skipped").otherwise("passed")
    told = F.coalesce(*[value(f"{t}/{w}") for t in ("failure", "error", "skipped") for w in ("@message", "text()")])
    return cases.select("report", F.coalesce(value("@name"), F.lit("unknown_test")).alias("name"), value("@classname").alias("classname"), value("@file").alias("file"), status.alias("status"), value("@time").try_cast("double").alias("seconds"), value("@line").try_cast("int").alias("line"), F.left(F.trim(told), F.lit(160)).alias("message"))


def junit_facts(cases: DataFrame) -> DataFrame:
    """(name, edge_type, confidence, message): what a test's result says; failures say more than passes."""
    detail = F.concat_ws("", F.when(F.col("seconds").isNotNull(), F.format_string(", duration_s %.3f", F.col("seconds"))), F.when(F.col("message").isNotNull(), F.concat(F.lit(", message "), "message")))
    message = F.concat(F.lit("JUnit observed test `"), "name", F.lit("` status "), "status", detail)
    return cases.select("name", F.lit("VALIDATES").alias("edge_type"), F.when(F.col("status") == "passed", "medium").otherwise("high").alias("confidence"), message.alias("message"))


def known_paths(reported: DataFrame, files: DataFrame) -> DataFrame:
    """reported (path, ...) with `file`: the path of files (path) that it means, by equality or as an ending; they meet on the
    file's name, and the shortest that fits counts."""
    name = F.lower(F.regexp_extract("path", r"[^/]*$", 0))
    paths = reported.select("path").distinct().withColumn("n", name)
    hits = paths.join(files.select(F.col("path").alias("file"), F.lower(F.regexp_extract("path", r"[^/]*$", 0)).alias("n")), "n").where(suffix_match(F.col("file"), F.col("path")))
    best = hits.groupBy("path").agg(F.min(F.struct(F.length("file"), "file"))["file"].alias("file"))
    return reported.join(best, "path")


def coverage_facts(covered: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(path, test_path, edge_type, symbol_id, lines, confidence): covered (path, line) files and the tests that are linked
    (path, test_path) to them; with the symbol (path, symbol_id, start_line, end_line) of the first covered line in one."""
    sizes = covered.groupBy("path").agg(F.countDistinct("line").alias("lines"))
    inside = covered.join(symbols, "path").where("line BETWEEN start_line AND end_line").groupBy("path").agg(F.min_by("symbol_id", F.struct("line", "start_line", "symbol_id")).alias("symbol_id"))
    out = links.select("path", "test_path").join(sizes, "path").join(inside, "path", "left")
    return out.select("path", "test_path", F.lit("TEST_COVERS").alias("edge_type"), "symbol_id", "lines", F.when(F.col("symbol_id").isNotNull(), "high").otherwise("medium").alias("confidence"))


def cochange_facts(pairs: DataFrame, most: int = 5000) -> DataFrame:
    """(path, target, confidence_score): the strongest co-change pairs (path, other, recency) as facts, 0.45 and a quarter of
    the recency up to 0.90."""
    score = F.least(0.45 + F.col("recency") / 4.0, F.lit(0.90))
    return pairs.orderBy(F.col("recency").desc(), "path", "other").limit(most).select("path", F.col("other").alias("target"), F.round(score, 6).alias("confidence_score"))


def index_quality(files: DataFrame, symbols: DataFrame, facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: files, files with symbols and their share, symbols, facts, imports by how they were resolved."""
    scalar = lambda df, c: df.agg(c).scalar()
    out = files.agg(F.count("*").alias("files"))
    # both figures of symbols from one pass
    each = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    out = out.withColumn("symbols", scalar(each, F.coalesce(F.sum("n"), F.lit(0)))).withColumn("covered", scalar(each, F.count("file_id"))).withColumn("facts", scalar(facts, F.count("*")))
    for status in ("resolved", "external", "unresolved"):
        out = out.withColumn(status, scalar(resolved, F.count(F.when(F.col("status") == status, 1))))
    return out.withColumn("coverage", F.round(F.when(F.col("files") == 0, 1.0).otherwise(F.col("covered") / F.col("files")), 6))
