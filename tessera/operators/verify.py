"""Impact of changed files, tests for them, public surfaces, boundaries, and what a change is held against."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identifiers as N
from tessera.functions import scores as S
from tessera.functions.identifiers import any_of
from tessera.functions.paths import parent, stem
from tessera.operators.rules import glob_pattern

# What a public declaration begins with, by language: (language, pattern of keyword and name, kinds by keyword).
PUBLIC = {
    "rust": (r"^\s*pub(?:\([^)]*\))?\s+(?:(?:async|unsafe|extern|const)\s+)*((fn|struct|enum|trait|type|static|mod)\s+([A-Za-z0-9_]+).*)$", {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "static": "constant", "mod": "module"}),
    "javascript": (r"^\s*export\s+(?:default\s+)?(?:(?:async|declare)\s+)*((function|class|interface|type|const|let|var|enum)\s+([A-Za-z0-9_]+).*)$", {"function": "function", "class": "class", "interface": "interface", "type": "type", "const": "constant", "let": "variable", "var": "variable", "enum": "enum"}),
    "python": (r"^((def|class)\s+([A-Za-z0-9][A-Za-z0-9_]*).*)$", {"def": "function", "class": "class"}),
    "go": (r"^\s*((func|type|const|var)\s+([A-Z][A-Za-z0-9_]*).*)$", {"func": "function", "type": "type", "const": "constant", "var": "variable"}),
    "java": (r"^(?=.*\bpublic\b)\s*(.*?\b(class|interface|enum|record)\s+([A-Za-z0-9_]+).*)$", {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}),
}
JAVA_METHOD = r"^(?=.*\bpublic\b)\s*([^(]*?([^\s(]+)\s*\(.*)$"
COMPONENT_MARKS = (("api", "/api/"), ("service", "/service"), ("repository", "/repo"), ("tests", "/test"), ("configuration", "config"))
OUTCOMES = {"failed": "validation_command_failed", "denied": "validation_command_denied", "error": "validation_command_error"}


def normal_signature(c: Column) -> Column:
    """Up to a comment, brace or semicolon, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(//|\{|;).*$", ""), r"\s+", " "))


def public_surface(files: DataFrame) -> DataFrame:
    """(path, kind, symbol, signature) of public declarations of files (path, language, text); the first of each."""
    lines = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.where((F.trim("line") != "") & ~F.trim("line").rlike(r"^(//|#|\*)"))
    out = []
    for language, (pattern, kinds) in PUBLIC.items():
        part = lambda n, p=pattern: F.regexp_extract("line", p, n)
        kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), part(2))
        out.append(lines.where(F.col("language").isin(language, "typescript") if language == "javascript" else F.col("language") == language).select("path", "i", kind.alias("kind"), part(3).alias("symbol"), normal_signature(part(1)).alias("signature")))
    method = lambda n: F.regexp_extract("line", JAVA_METHOD, n)
    plain = lines.where((F.col("language") == "java") & (F.regexp_extract("line", PUBLIC["java"][0], 3) == ""))
    out.append(plain.select("path", "i", F.lit("method").alias("kind"), method(2).alias("symbol"), normal_signature(method(1)).alias("signature")))
    rows = reduce(DataFrame.unionByName, out).where("symbol <> '' AND kind IS NOT NULL")
    return rows.groupBy("path", "kind", "symbol").agg(F.min_by("signature", "i").alias("signature"))


def surface_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, symbol, change): removed, added, or changed in signature."""
    key = ["path", "kind", "symbol"]
    both = before.select(*key, F.sha2("signature", 256).alias("b")).join(after.select(*key, F.sha2("signature", 256).alias("a")), key, "full_outer")
    change = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def changed_files(diff: Column) -> Column:
    """Sorted paths that a unified diff names: new ones, and old ones of files that it deletes."""
    found = lambda p: F.regexp_extract_all(diff, F.lit(p), F.lit(1))
    new = F.filter(found(r"(?m)^\+\+\+ (?:[ab]/)?(\S+)"), lambda x: x != "/dev/null")
    return F.array_sort(F.array_distinct(F.concat(found(r"(?m)^diff --git \S+ b/(\S+)"), new, found(r"(?m)^--- (?:[ab]/)?(\S+)[^\n]*\n\+\+\+ /dev/null"))))


def boundary_matches(pattern: str, path: Column) -> Column:
    """Exact, a folder and all below (x/**), a folder anywhere (**/x/**), or parts in order between stars."""
    pattern = pattern.removeprefix("./").replace("\\", "/")
    out = path == pattern
    if pattern.endswith("/**"):
        head = pattern[:-3]
        inner = head.removeprefix("**/")
        out = out | (path == inner) | path.startswith(f"{inner}/")
        return out | path.contains(f"/{inner}/") if inner != head else out
    if "*" in pattern:
        return out | path.rlike("(?s)" + ".*".join(f"\\Q{p}\\E" for p in pattern.split("*") if p))
    return out


def boundary_findings(changed: DataFrame, allowed: Sequence[str], caution: Sequence[str], forbidden: Sequence[str], rules: Sequence[tuple[str, str]], evidence: bool) -> DataFrame:
    """(path, kind, reason) of changed (path) that a plan's boundary doesn't let pass: forbidden files, then forbidden
    (pattern, reason), then files neither allowed nor named with caution, unless evidence was given. The boundary is one
    plan's, so it is written into the expression."""
    path = F.regexp_replace("path", r"^(\./)+", "")
    kind = F.when(path.isin(*forbidden) if forbidden else F.lit(False), F.struct(F.lit("forbidden_boundary").alias("kind"), F.lit("matches forbidden contract file").alias("reason")))
    for pattern, reason in rules:
        kind = kind.when(boundary_matches(pattern, path), F.struct(F.lit("forbidden_boundary").alias("kind"), F.lit(f"matches forbidden pattern `{pattern}`: {reason}").alias("reason")))
    known = path.isin(*allowed, *caution) if (allowed or caution) else F.lit(False)
    kind = kind.when(~known & F.lit(not evidence), F.struct(F.lit("out_of_boundary").alias("kind"), F.lit("outside the boundary, without evidence for more").alias("reason")))
    return changed.select("path", kind.alias("f")).where("f IS NOT NULL").select("path", "f.*")


def boundary_sets(primary: DataFrame, impacts: DataFrame, allowed: DataFrame, caution: DataFrame) -> DataFrame:
    """(path, part): allowed are the primary paths and those allowed before, caution the impacted ones beyond them."""
    ok = primary.select("path").union(allowed.select("path")).distinct()
    careful = impacts.select("path").union(caution.select("path")).distinct().join(ok, "path", "left_anti")
    return ok.withColumn("part", F.lit("allowed")).unionByName(careful.withColumn("part", F.lit("caution")))


def missing_tests(recommended: DataFrame, planned: DataFrame) -> DataFrame:
    """Recommended tests (test_id, name) whose id and name the plan (test_id, name) both lacks."""
    names = planned.select(F.col("test_id").alias("x")).union(planned.select("name")).distinct()
    return recommended.join(names, recommended.test_id == names.x, "left_anti").join(names, recommended.name == names.x, "left_anti")


def unplanned_impacts(impacts: DataFrame, planned: DataFrame, most: int = 12) -> DataFrame:
    """(path): of each changed file's first impacts (changed, path, rank) those that no plan names."""
    return impacts.where(F.col("rank") <= most).select("path").distinct().join(planned.select("path"), "path", "left_anti")


def verdict(findings: Column, warnings: Column) -> Column:
    return F.when(findings > 0, "fail").when(warnings > 0, "warn").otherwise("pass")


def attestation_findings(requirements: DataFrame, attestations: DataFrame, contract: str, digest: str, updated_at: Column) -> DataFrame:
    """(id, kind): what is wrong with attestations (id, requirement, contract, digest, created_at, outcome, command, cwd) and
    which requirements (requirement, command, cwd) have none; nothing if there are no attestations at all."""
    checks = F.array(
        F.when((F.col("contract") != contract) | (F.col("digest") != digest), "validation_attestation_contract_mismatch"),
        F.when(F.col("created_at") < updated_at, "validation_attestation_stale"),
        F.try_element_at(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair]), F.col("outcome")),
    )
    own = attestations.select("id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("kind"))
    last = attestations.groupBy("requirement").agg(F.max_by(F.struct("id", "command", "cwd"), "created_at").alias("a"))
    held = requirements.join(last, "requirement", "left")
    some = attestations.limit(1).select(F.lit(1).alias("one"))
    missing = held.where("a IS NULL").join(some, F.lit(True), "left_semi").select(F.col("requirement").alias("id"), F.lit("validation_attestation_missing").alias("kind"))
    replay = held.where((F.col("a.command") != F.col("command")) | (F.col("a.cwd") != F.coalesce("cwd", F.lit(".")))).select(F.col("a.id").alias("id"), F.lit("validation_command_replay_mismatch").alias("kind"))
    return own.unionByName(missing).unionByName(replay)


def exemption_scope(source: Column, target: Column, paths: Sequence[str], scopes: Sequence[str], copied: Column, generated: Column) -> Column:
    """Why an edge is exempt: a path of either end, or its being a test, copied or generated; else null."""
    either = lambda holds: holds(source) | holds(target)
    segment = lambda name: either(lambda p: p.rlike(f"(^|/){name}(/|$)"))
    out = F.lit(None).cast("string")
    tests = either(lambda p: p.rlike(r"^tests/|/tests?/|_test\.|\.test\."))
    for scope, holds in reversed([(s, {"tests": tests, "vendor": copied | segment("vendor"), "generated": generated | segment("generated")}.get(s, F.lit(False))) for s in scopes]):
        out = F.when(holds, scope).otherwise(out)
    named = any_of(either(lambda p, g=g: p.rlike(glob_pattern(g))) for g in paths)
    return F.when(named, "configured_path").otherwise(out)


def public_api_findings(edges: DataFrame, rules: Sequence[tuple[str, str, str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(source, target, rule, kind) of edges (source, target) into a component past its public files.

    rules: (id, component glob, reason, public globs, internal globs). An edge from outside the component breaks a rule if
    its target is internal, or in none of the public globs. Rules are a policy's few, written into the expression.
    """
    inside = lambda p, globs: any_of(p.rlike(glob_pattern(g)) for g in globs)
    source, target, out = F.col("source"), F.col("target"), []
    for name, component, _, public, internal in rules:
        into = inside(target, [component]) & ~inside(source, [component])
        kind = F.when(into & inside(target, internal), "internal").when(into & ~inside(target, public), "outside_public")
        out.append(F.struct(F.lit(name).alias("rule"), kind.alias("kind")))
    return edges.select("source", "target", F.explode(F.array(*out)).alias("r")).select("source", "target", "r.*").where("kind IS NOT NULL")


def keyword_components(paths: DataFrame) -> DataFrame:
    """(component, path): components by marks in paths, where there is no policy."""
    marks = F.array(*[F.when(F.lower("path").contains(m), name) for name, m in COMPONENT_MARKS])
    return paths.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("component"), "path")


def impacts(references: DataFrame, cochange: DataFrame, shared: DataFrame, changed: str, limit: int = 25) -> DataFrame:
    """(path, score, reasons): what a changed path reaches: files that refer to its symbols (path, confidence), 1.25 and the
    confidence; files that change with it (path, confidence), 0.18 and a little; files that share its endpoints, topics,
    tables or runtime targets (path, target), 0.20. The best of a path counts, its reasons are kept."""
    a = references.select("path", (1.25 + S.confidence_value(F.col("confidence"))).alias("score"), F.lit("exact reference").alias("reason"))
    b = cochange.select("path", (0.18 + F.least(S.confidence_value(F.col("confidence")) * 0.05, F.lit(0.05))).alias("score"), F.lit("co-change").alias("reason"))
    c = shared.select("path", F.lit(0.20).alias("score"), F.concat(F.lit("shared "), "target").alias("reason"))
    whole = a.unionByName(b).unionByName(c).where(F.col("path") != changed)
    best = whole.groupBy("path").agg(F.round(F.max("score"), 6).alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return best.orderBy(F.col("score").desc(), "path").limit(limit)


def shared_targets(facts: DataFrame, path: str) -> DataFrame:
    """(path, target): files with a fact (path, target) that the path has too."""
    mine = facts.where(F.col("path") == path).select("target").distinct()
    return facts.where(F.col("path") != path).join(mine, "target", "left_semi").select("path", "target").distinct()


def impact_terms(symbols: DataFrame, path: str) -> DataFrame:
    """(term): names of a path's symbols (path, name) and its stem, none too general, the longest first."""
    names = symbols.where(F.col("path") == path).select(F.col("name").alias("term")).union(symbols.sparkSession.range(1).select(stem(F.lit(path.rsplit("/", 1)[-1]))))
    return names.where(~N.is_generic(F.col("term"))).distinct().orderBy(F.length("term").desc(), "term")


def select_with_evidence(tests: DataFrame, changed: DataFrame, overlap: DataFrame, runtime: DataFrame, history: DataFrame, coverage: DataFrame, results: DataFrame, limit: int = 8) -> DataFrame:
    """(changed, rank, test_id, score, confidence): tests for changed files.

    tests (test_id, name, path, command, confidence) that are candidates for changed (changed, path): those of overlap,
    of the same stem or folder, or with history or coverage. overlap (changed, test_id, shared): symbols in common;
    runtime and history (changed, path): test files that runtime facts and co-change name; coverage (changed, path,
    by_symbol); results (path, failed): a test file's earlier results. Score: confidence; 0.5 and 0.05 a shared symbol up
    to five; 0.2 for the stem in the test's name, 0.1 for a part of the path; 0.20, 0.18; 0.30 or 0.18; 0.22 or 0.08 for
    up to four results; 0.05 for a command.
    """
    t = tests.withColumn("folder", parent(F.col("path"))).withColumn("stem", F.regexp_replace(stem(F.col("path")), "_?test_?", ""))
    c = changed.withColumn("folder", parent(F.col("path"))).withColumn("stem", stem(F.col("path")))
    files = t.select("test_id", "path")
    by_file = lambda df: df.select("changed", "path").join(files, "path").select("changed", "test_id")
    pairs = [overlap.select("changed", "test_id"), c.where(F.length("stem") > 3).join(t.select("test_id", "stem"), "stem").select("changed", "test_id"), by_file(history), by_file(coverage)]
    near = reduce(DataFrame.unionByName, pairs).distinct()
    rows = near.join(tests, "test_id").join(c.select("changed", F.lower("path").alias("c_path"), F.lower("stem").alias("c_stem")), "changed").join(overlap.groupBy("changed", "test_id").agg(F.max("shared").alias("shared")), ["changed", "test_id"], "left")
    mark = lambda df, name: df.select("changed", "path").distinct().withColumn(name, F.lit(True))
    rows = rows.join(mark(runtime, "ran"), ["changed", "path"], "left").join(mark(history, "co"), ["changed", "path"], "left")
    rows = rows.join(coverage.groupBy("changed", "path").agg(F.max("by_symbol").alias("by_symbol")), ["changed", "path"], "left")
    seen = results.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.col("failed").desc()))).where("_n <= 4").groupBy("path").agg(F.sum(F.when(F.col("failed"), 0.22).otherwise(0.08)).alias("seen"))
    rows = rows.join(seen, "path", "left")
    text = F.lower(F.concat_ws(" ", F.col("test_id").cast("string"), "name", "command"))
    shared = F.coalesce("shared", F.lit(0))
    score = S.confidence_value(F.col("confidence")) + F.when(shared > 0, 0.5 + F.least(shared, F.lit(5)) * 0.05).otherwise(0.0)
    score = score + F.when((F.col("c_stem") != "") & text.contains(F.col("c_stem")), 0.2).otherwise(0.0) + F.when(F.exists(N.path_tokens(F.col("c_path")), lambda p: text.contains(p)), 0.1).otherwise(0.0)
    score = score + F.when(F.col("ran"), 0.20).otherwise(0.0) + F.when(F.col("co"), 0.18).otherwise(0.0) + F.when(F.col("by_symbol"), 0.30).when(~F.col("by_symbol"), 0.18).otherwise(0.0)
    score = score + F.coalesce("seen", F.lit(0.0)) + F.when(F.col("command").isNotNull(), 0.05).otherwise(0.0)
    order = Window.partitionBy("changed").orderBy(F.col("score").desc(), "name", "test_id")
    best = rows.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("changed", "rank", "test_id", "score", F.when(F.col("score") > 0.85, "high").when(F.col("score") > 0.55, "medium").otherwise("low").alias("confidence"))


def linked_tests(covered: DataFrame, tests: DataFrame, most: int = 8) -> DataFrame:
    """(path, test_path, links): test files for covered paths: 3 for the stem in path or name, 1 for the same top folder, 1 for
    looking like a test. Pairs meet on a word of the test's path or name, or on the top folder of files that share no word,
    and of those only the first `most` of each folder can count."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
    top = lambda c: F.regexp_extract(F.lower(c), "^[^/]*", 0)
    t = tests.select(F.col("path").alias("test_path"), F.lower(F.concat_ws(" ", "path", "name")).alias("text"), top(F.col("path")).alias("area")).withColumn("looks", F.col("test_path").rlike("(?i)test|spec").cast("int"))
    c = covered.select("path", F.lower(stem(F.col("path"))).alias("s"), top(F.col("path")).alias("area")).distinct()
    by_word = c.where("s <> ''").withColumn("word", F.explode(words(F.col("s")))).join(t.withColumn("word", F.explode(words(F.col("text")))).drop("area"), "word").where(F.col("text").contains(F.col("s"))).select("path", "test_path")
    first = t.withColumn("_n", F.row_number().over(Window.partitionBy("area").orderBy(F.col("looks").desc(), "test_path"))).where(F.col("_n") <= most)
    anywhere = t.where("looks = 1").orderBy("test_path").limit(most).select("test_path")
    pairs = by_word.union(c.join(first.select("area", "test_path"), "area").select("path", "test_path")).union(c.select("path").join(F.broadcast(anywhere), F.lit(True)).select("path", "test_path")).distinct()
    rows = pairs.join(c.withColumnRenamed("area", "c_area"), "path").join(t.groupBy("test_path", "area", "looks").agg(F.max("text").alias("text")), "test_path")
    links = F.when((F.col("s") != "") & F.col("text").contains(F.col("s")), 3).otherwise(0) + F.when(F.col("area") == F.col("c_area"), 1).otherwise(0) + F.col("looks")
    order = Window.partitionBy("path").orderBy(F.col("links").desc(), "test_path")
    return rows.withColumn("links", links).where("links > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("path", "test_path", "links")
