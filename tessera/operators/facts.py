"""Declarations, imports, tests and framework facts of source files, line by line, and the graph that they make."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.functions.paths import endpoint, is_test

WORD = r"([A-Za-z_]\w*)"
JS = r"([A-Za-z_$][\w$]*)"
#: A quoted text of which group 1 or 2 is the inside.
QUOTED = r"""["']([^"']+)["']"""

# What declares a symbol, by language: (language, kind, pattern whose group 1 is the name).
DECLARATIONS = [
    ("rust", "function", rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+{WORD}"), ("rust", "class", rf"^\s*(?:pub\s+)?(?:struct|enum)\s+{WORD}"),
    ("rust", "trait", rf"^\s*(?:pub\s+)?trait\s+{WORD}"), ("rust", "module", rf"^\s*mod\s+{WORD}"),
    ("java", "class", rf"\b(?:class|record)\s+{WORD}"), ("java", "interface", rf"\binterface\s+{WORD}"),
    ("java", "method", r"\b(?:(?:public|private|protected)\s+)?(?:static\s+)?[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
    ("javascript", "function", rf"\bfunction\s+{JS}"), ("javascript", "class", rf"\bclass\s+{JS}"), ("javascript", "interface", rf"\binterface\s+{JS}"),
    ("javascript", "function", rf"\b(?:const|let|var)\s+{JS}\s*=\s*(?:async\s*)?\("), ("javascript", "variable", rf"\bexport\s+(?:const|let|var)\s+{JS}"),
    ("python", "function", rf"^\s*(?:async\s+)?def\s+{WORD}"), ("python", "class", rf"^\s*class\s+{WORD}"),
    ("go", "function", rf"^\s*func\s+(?:\([^)]+\)\s*)?{WORD}"), ("go", "class", rf"^\s*type\s+{WORD}\s+struct"), ("go", "interface", rf"^\s*type\s+{WORD}\s+interface"),
    ("sql", "database_table", r"(?i)^\s*create\s+table\s+([A-Za-z_][\w.]*)"),
]
# What imports, by language: (language, pattern whose group 1 is the import).
IMPORTED = [
    ("rust", r"^\s*use\s+([^;]+)"), ("rust", rf"^\s*mod\s+{WORD}"), ("java", r"^\s*import\s+([^;]+)"), ("javascript", rf"from\s+{QUOTED}"), ("javascript", rf"import\s+{QUOTED}"),
    ("python", r"^\s*import\s+([\w.]+)"), ("python", r"^\s*from\s+([\w.]+)\s+import"), ("go", r'^\s*import\s+"([^"]+)"'),
]
_VERBS = "get|post|put|delete|patch"


def _route(fallback: str = "") -> Callable:
    """Group 1 in capitals, or HTTP for the fallback, and group 2."""
    return lambda g: F.concat_ws(" ", F.when(g(1) == fallback, "HTTP").otherwise(F.upper(g(1))), g(2))


def _http(g) -> Column:
    return F.concat(F.lit("HTTP "), g(1))


def _spring(g) -> Column:
    verb = F.upper(F.regexp_extract(g(1), "^(Get|Post|Put|Delete|Patch)", 1))
    return F.concat_ws(" ", F.when(verb == "", "HTTP").otherwise(verb), F.when(g(2) == "", "/").otherwise(g(2)))


def _first(g) -> Column:
    return g(1)


# What frameworks write: (language, edge, kind of target, pattern, target from the pattern's groups).
FRAMEWORKS = [
    ("java", "EXPOSES_ENDPOINT", "endpoint", rf"@((?:Get|Post|Put|Delete|Patch|Request)Mapping)(?:\s*\(\s*(?:value\s*=\s*)?{QUOTED})?", _spring),
    ("java", "READS_CONFIG", "config_key", rf"System\.getenv\(\s*{QUOTED}\s*\)", _first),
    ("java", "READS_CONFIG", "config_key", r"""@Value\(\s*["']\$\{([^}:]+)(?::[^}]*)?\}["']\s*\)""", _first),
    ("java", "READS_TABLE", "database_table", rf"@Table\(\s*name\s*=\s*{QUOTED}", _first),
    ("java", "CALLS_ENDPOINT", "endpoint", rf"\b(?:getForObject|postForObject|put|delete|exchange)\(\s*{QUOTED}", _http),
    ("java", "CONSUMES_EVENT", "topic", rf"@KafkaListener\([^)]*topics\s*=\s*{QUOTED}", _first),
    ("java", "PUBLISHES_EVENT", "topic", rf"\bkafkaTemplate\.send\(\s*{QUOTED}", _first),
    ("javascript", "EXPOSES_ENDPOINT", "endpoint", rf"\b(?:app|router)\.({_VERBS}|all)\(\s*{QUOTED}", _route()),
    ("javascript", "CALLS_ENDPOINT", "endpoint", rf"\b(?:axios|client|http)\.({_VERBS})\(\s*{QUOTED}", _route()),
    ("javascript", "CALLS_ENDPOINT", "endpoint", rf"\bfetch\(\s*{QUOTED}", _http),
    ("javascript", "PUBLISHES_EVENT", "topic", rf"\b(?:producer|publisher|pubsub|channel)\.(?:send|publish|emit)\(\s*(?:\{{[^}}]*topic\s*:\s*)?{QUOTED}", _first),
    ("javascript", "CONSUMES_EVENT", "topic", rf"\b(?:consumer|subscriber|pubsub|channel)\.(?:subscribe|on)\(\s*(?:\{{[^}}]*topic\s*:\s*)?{QUOTED}", _first),
    ("python", "EXPOSES_ENDPOINT", "endpoint", rf"@(?:app|router|blueprint)\.({_VERBS}|route)\(\s*{QUOTED}", _route("route")),
    ("python", "CALLS_ENDPOINT", "endpoint", rf"\b(?:requests|httpx)\.({_VERBS})\(\s*{QUOTED}", _route()),
    ("python", "PUBLISHES_EVENT", "topic", rf"\b(?:producer|publisher|client)\.send\(\s*{QUOTED}", _first),
    ("python", "CONSUMES_EVENT", "topic", rf"\b(?:consumer|subscriber)\.subscribe\(\s*\[?\s*{QUOTED}", _first),
    ("rust", "EXPOSES_ENDPOINT", "endpoint", rf"#\[({_VERBS})\(\s*{QUOTED}\s*\)\]", _route()),
    ("rust", "CALLS_ENDPOINT", "endpoint", rf"\breqwest::({_VERBS})\(\s*{QUOTED}", _route()),
    ("terraform", "READS_CONFIG", "config_key", r'variable\s+"([^"]+)"', _first),
    ("dockerfile", "WRITES_CONFIG", "config_key", r"^\s*ENV\s+([^=]+?)\s*=", _first),
    ("config", "CALLS_ENDPOINT", "endpoint", r"""["']?(?:url|endpoint|base_url)["']?\s*[:=]\s*["'](https?://[^"']+)["']""", _http),
]


def by_line(files: DataFrame, rules: list[tuple], build: Callable[[tuple, Column, Callable], Column], every: bool) -> DataFrame:
    """(file_id, language, path, line, found.*): what the rules of a file's language find in its lines, all matches in a
    line or the first. Rules are a constant of a few rows: their patterns are columns of the same row, and no join."""

    def found(rule: tuple) -> Column:
        pattern = next(x for x in rule[1:] if isinstance(x, str) and any(c in x for c in r"\^("))

        def of(line: Column, i: Column) -> Column:
            hits = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
            hits = hits if every else F.slice(hits, 1, 1)
            return F.transform(hits, lambda m: F.struct((i + 1).cast("long").alias("line"), build(rule, line, lambda n: F.regexp_extract(m, pattern, n)).alias("found")))

        return F.when(F.col("language") == rule[0], F.flatten(F.transform("lines", of)))

    rows = files.select("file_id", "language", "path", F.split("text", "\n").alias("lines"))
    whole = F.flatten(F.filter(F.array(*[found(r) for r in rules]), lambda x: x.isNotNull()))
    return rows.select("file_id", "language", "path", F.explode(whole).alias("r")).select("file_id", "language", "path", "r.line", "r.found.*")


def declarations(files: DataFrame) -> DataFrame:
    """(file_id, language, path, line, kind, name): symbols that a line declares, one for each pattern."""
    return by_line(files, DECLARATIONS, lambda r, _, g: F.struct(F.lit(r[1]).alias("kind"), g(1).alias("name")), False).where("name <> ''")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, language, path, line, imported)."""
    return by_line(files, IMPORTED, lambda r, _, g: F.struct(F.trim(g(1)).alias("imported")), False).where("imported <> ''")


def framework_facts(files: DataFrame) -> DataFrame:
    """(file_id, line, edge_type, target_kind, target): endpoints, clients, topics, tables and configuration that lines name."""
    build = lambda r, _, g: F.struct(F.lit(r[1]).alias("edge_type"), F.lit(r[2]).alias("target_kind"), r[4](g).alias("target"))
    return by_line(files, FRAMEWORKS, build, True).select("file_id", "line", "edge_type", "target_kind", "target").distinct()


def inheritance(files: DataFrame) -> DataFrame:
    """(file_id, line, edge_type, target_kind, target): what Java classes and interfaces extend and implement."""
    types = r"([\w.$<>,\s]+?)"
    rules = [
        ("java", "EXTENDS", "class", rf"\b(?:class|record|enum)\s+\w+\s+extends\s+([\w.$<>]+)"),
        ("java", "IMPLEMENTS", "interface", rf"\b(?:class|record|enum)\s+\w+(?:\s+extends\s+[\w.$<>]+)?\s+implements\s+{types}\s*(?:\{{|$)"),
        ("java", "EXTENDS", "interface", rf"\binterface\s+\w+\s+extends\s+{types}\s*(?:\{{|$)"),
    ]
    build = lambda r, _, g: F.struct(F.lit(r[1]).alias("edge_type"), F.lit(r[2]).alias("target_kind"), g(1).alias("all"))
    bare = F.transform(F.split("all", ","), lambda x: F.regexp_replace(x, r"^\s+|<.*$|[>\s]+$", ""))
    return by_line(files, rules, build, False).select("file_id", "line", "edge_type", "target_kind", F.explode(bare).alias("target")).where("target <> ''").distinct()


def infrastructure(files: DataFrame) -> DataFrame:
    """(file_id, line, edge_type, target_kind, target) of Dockerfiles, compose files, Kubernetes and Terraform resources.

    A compose line belongs to the last heading before it; a Kubernetes resource is a kind with the first name that
    follows or precedes it since the last one.
    """
    lines = files.select("file_id", "language", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("line", (F.col("i") + 1).cast("long")).withColumn("bare", F.trim("t"))
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)

    def fact(rows: DataFrame, edge: str | Column, kind: str | Column, target: Column) -> DataFrame:
        col = lambda x: F.lit(x) if isinstance(x, str) else x
        return rows.select("file_id", "line", col(edge).alias("edge_type"), col(kind).alias("target_kind"), target.alias("target"))

    ports = lines.where("language = 'dockerfile' AND bare LIKE 'EXPOSE %'").withColumn("port", F.explode(F.split(F.substr("bare", F.lit(8)), r"\s+")))
    out = [fact(ports, "EXPOSES_ENDPOINT", "endpoint", F.concat(F.lit("TCP :"), F.regexp_extract("port", "^[^/]*", 0)))]

    compose = lines.where("language = 'compose'").withColumn("inside", F.max(F.col("bare") == "services:").over(Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)))
    service = F.regexp_extract("t", r"^\s{2}([\w.-]+):\s*$", 1)
    deep = F.col("t").startswith("      ")
    head = lambda name: F.last(F.when((service == "") & (F.col("bare") == name), True).when((service != "") | ~deep, False), ignorenulls=True).over(before)
    compose = compose.withColumn("service", service).withColumn("in_env", head("environment:")).withColumn("in_deps", head("depends_on:")).where("inside")
    port, key, dep = F.regexp_extract("t", r"""^\s*-\s*["']?(?:\d+:)?(\d+)(?:/tcp|/udp)?["']?\s*$""", 1), F.regexp_extract("t", r"^\s*([A-Z_][A-Z0-9_]+):", 1), F.regexp_extract("t", r"^\s*-\s*([\w.-]+)\s*$", 1)
    out.append(fact(compose.where("service <> ''"), "DEFINES", "resource", F.concat(F.lit("compose:service:"), "service")))
    rest = compose.where("service = ''")
    out.append(fact(rest.where(port != ""), "EXPOSES_ENDPOINT", "endpoint", F.concat(F.lit("TCP :"), port)))
    out.append(fact(rest.where(F.col("in_env") & (key != "")), "WRITES_CONFIG", "config_key", key))
    out.append(fact(rest.where(F.col("in_deps") & (dep != "")), "DEPENDS_ON", "resource", F.concat(F.lit("compose:service:"), dep)))

    cluster = lines.where("language = 'yaml'")
    kind, name = F.nullif(F.trim(F.regexp_extract("bare", "^kind:(.*)$", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract("bare", "^name:(.*)$", 1)), F.lit(""))
    parts = cluster.withColumn("kind", kind).withColumn("name", name)
    # a resource is complete where its kind and its first name have both been seen
    state = F.aggregate(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))), F.expr("named_struct('k', CAST(NULL AS STRING), 'n', CAST(NULL AS STRING), 'done', CAST(array() AS array<struct<line: bigint, kind: string, name: string>>))"), _pair)
    done = parts.where("kind IS NOT NULL OR name IS NOT NULL").groupBy("file_id").agg(state["done"].alias("done")).select("file_id", F.explode("done").alias("d"))
    out.append(fact(done.select("file_id", "d.*"), "DEFINES", "resource", F.concat_ws(":", F.lit("kubernetes"), "kind", "name")))
    listen = F.regexp_extract("bare", r"^(?:- )?port:\s*(\d+)$", 1)
    out.append(fact(cluster.where(listen != ""), "EXPOSES_ENDPOINT", "endpoint", F.concat(F.lit("TCP :"), listen)))

    pair = lambda n: F.regexp_extract("t", r'resource\s+"([^"]+)"\s+"([^"]+)"', n)
    terraform = lines.where("language = 'terraform'").withColumn("kind", pair(1)).withColumn("name", pair(2)).where("kind <> ''")
    queue, topic = F.col("kind").rlike("sqs|queue"), F.col("kind").rlike("sns|topic")
    out.append(fact(terraform, "DEFINES", F.when(queue, "queue").when(topic, "topic").otherwise("resource"), F.when(queue | topic, F.col("name")).otherwise(F.concat_ws(":", F.lit("terraform"), "kind", "name"))))
    return reduce(DataFrame.unionByName, out).distinct()


def _pair(s: Column, x: Column) -> Column:
    kind, name = F.coalesce(x["kind"], s["k"]), F.coalesce(s["n"], x["name"])
    both = kind.isNotNull() & name.isNotNull()
    found = F.array(F.struct(x["line"].alias("line"), kind.alias("kind"), name.alias("name")))
    return F.struct(F.when(~both, kind).alias("k"), F.when(~both, name).alias("n"), F.when(both, F.concat(s["done"], found)).otherwise(s["done"]).alias("done"))


def test_command(language: Column, path: Column, build: str | None = None) -> Column:
    """What runs a language's tests."""
    java = {"gradle": "./gradlew test", "bazel": "bazel test //..."}.get(build or "", "mvn test")
    out = F.when(language == "java", java).when(language == "rust", "cargo test").when(language.isin("typescript", "javascript"), "npm test")
    return out.when(language == "python", "pytest").when(language == "go", "go test ./...").when(path.contains("test"), "run repository test command")


def tests(files: DataFrame, declared: DataFrame, build: str | None = None) -> DataFrame:
    """(test_id, file_id, name, line, command, confidence): symbols of test files, named as tests, or of files with test marks."""
    marked = files.select("file_id", F.col("text").rlike(r"#\[test\]|@Test").alias("marked"))
    rows = declared.join(marked.hint("merge"), "file_id").withColumn("in_tests", is_test(F.col("path")))
    rows = rows.where(F.col("in_tests") | F.col("name").startswith("test") | F.col("marked"))
    key = I.stable_hash(F.concat_ws(":", F.lit("test"), "path", "name"))
    return rows.select(key.alias("test_id"), "file_id", "name", "line", test_command(F.col("language"), F.col("path"), build).alias("command"), F.when(F.col("in_tests"), "high").otherwise("medium").alias("confidence"))


def plausible_test(name: Column) -> Column:
    """Whether a name looks like a test's: not a constant, not a validator's, but named as one, a class's or a snake_case name."""
    constant = name.rlike(r"^[\p{Lu}_\p{N}]*$") & name.rlike(r"\p{L}")
    validator = F.lower(name).isin("validationtest", "validationtests", "validatortest", "validatortests")
    named = name.rlike("Test|test") | name.endswith("IT") | name.endswith("Spec")
    return ~constant & ~validator & (named | (name.rlike(r"^\p{Lu}.*\p{Ll}") & (F.length(name) > 8)) | name.rlike(r"^\p{Ll}.*_"))


def symbol_ids(declared: DataFrame, files: DataFrame) -> DataFrame:
    """declared with qualified_name and symbol_id, one row for each id.

    Here and below a side that has a row for each file is joined by sorting: Catalyst takes it for small, as it does not know
    how long the texts are that its columns are made of, and would replicate it.
    """
    packages = files.select("file_id", I.package_of_text(F.col("text")).alias("package"))
    named = declared.join(packages.hint("merge"), "file_id").withColumn("qualified_name", I.qualified_name(F.col("path"), F.col("language"), F.col("package"), F.col("name"))).drop("package")
    return named.withColumn("symbol_id", I.stable_hash(F.concat_ws(":", "path", F.col("line").cast("string"), "qualified_name"))).dropDuplicates(["symbol_id"])


def occurrences(symbols: DataFrame) -> DataFrame:
    """(symbol_id, file_id, line, is_definition): one definition for each symbol."""
    return symbols.select("symbol_id", "file_id", "line", F.lit(True).alias("is_definition"))


def fact_ids(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """facts with fact_id, one row for each id, ambiguity, and properties of the target: protocol, method, raw and
    normalized path of endpoints, the trimmed name of topics, queues, keys and resources."""
    out = facts.join(paths.select("file_id", "path").hint("merge"), "file_id")
    out = out.withColumn("fact_id", I.stable_hash(F.concat_ws(":", F.lit("analysis"), "path", "edge_type", "target", F.col("line").cast("string")))).dropDuplicates(["fact_id"])
    e = endpoint(F.col("target"))
    of_endpoint = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("protocol", "method", "raw_path", "normalized_path"))), F.array(e["protocol"], e["method"], e["raw"], e["path"])), lambda _, v: v.isNotNull())
    named = F.col("target_kind").isin("queue", "topic", "config_key", "resource")
    nothing = F.create_map().cast("map<string,string>")
    properties = F.when(F.col("target_kind") == "endpoint", of_endpoint).when(named, F.create_map(F.lit("normalized_path"), F.trim("target"))).otherwise(nothing)
    unclear = (F.col("target_kind") == "endpoint") & e["method"].isNull() & (e["protocol"] == "http")
    return out.withColumn("properties", properties).withColumn("ambiguity", F.when(unclear, F.array(F.lit("HTTP method was not statically resolved"))).otherwise(F.array().cast("array<string>")))


def graph(files: DataFrame, symbols: DataFrame, imported: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type, label) and edges (id, from_id, to_id, edge_type, confidence, properties): files define symbols and
    import modules, and facts lead from files to what they name. Equal nodes and edges are one."""
    paths = files.select("file_id", I.file_node_id(F.col("path")).alias("from_id"))
    nodes = [files.select(I.file_node_id(F.col("path")).alias("id"), F.lit("file").alias("node_type"), F.col("path").alias("label"))]
    nodes.append(symbols.select(I.symbol_node_id(F.col("symbol_id")).alias("id"), F.col("kind").alias("node_type"), F.col("qualified_name").alias("label")))
    nodes.append(imported.select(I.target_node_id(F.lit("module"), F.col("imported")).alias("id"), F.lit("module").alias("node_type"), F.col("imported").alias("label")))
    nodes.append(facts.select(I.target_node_id(F.col("target_kind"), F.col("target")).alias("id"), F.col("target_kind").alias("node_type"), F.col("target").alias("label")))
    nothing, some = F.create_map().cast("map<string,string>"), ["file_id", "to_id", "edge_type", "confidence", "properties"]
    ends = [symbols.select("file_id", I.symbol_node_id(F.col("symbol_id")).alias("to_id"), F.lit("DEFINES").alias("edge_type"), F.lit("medium").alias("confidence"), nothing.alias("properties"))]
    ends.append(imported.select("file_id", I.target_node_id(F.lit("module"), F.col("imported")).alias("to_id"), F.lit("IMPORTS").alias("edge_type"), F.lit("medium").alias("confidence"), nothing.alias("properties")))
    own = F.create_map(F.lit("confidence"), F.lit("medium"), F.lit("target_kind"), F.col("target_kind"))
    ends.append(facts.select("file_id", I.target_node_id(F.col("target_kind"), F.col("target")).alias("to_id"), "edge_type", F.lit("medium").alias("confidence"), F.map_concat("properties", own).alias("properties")))
    edges = reduce(DataFrame.unionByName, [e.select(*some) for e in ends]).join(paths.hint("merge"), "file_id")
    edges = edges.withColumn("id", I.edge_id("edge_type", "from_id", "to_id")).select("id", "from_id", "to_id", "edge_type", "confidence", "properties")
    # of rows that are one node, the least label; properties are those of the first by label
    merged = reduce(DataFrame.unionByName, nodes).groupBy("id").agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"))
    return merged, edges.dropDuplicates(["id"])
