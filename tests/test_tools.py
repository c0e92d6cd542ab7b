"""Readers, tasks, plans, ownership and the facade on small inputs."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import changes as C
from tessera.operators import hybrid as Y
from tessera.operators import ownership as O
from tessera.operators import registry as G
from tessera.operators import search as S
from tessera.operators import tasks as K
from tessera.operators import verify as X
from tessera.operators.ranking import rank_by
from tessera.sources import readers as R
from tessera.sources.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def test_scan(spark, tmp_path):
    files = {"src/a.py": "import os\n", "src/gen.rs": "// Code generated by x\n", "vendor/b.go": "x", ".env": "KEY=1", "docs/c.md": "text", "big.txt": "x" * 3000, "out/d.txt": "y", "Cargo.toml": ""}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = R.scan(spark, str(tmp_path), ("out/**",), 2000, fast=True)
    rows = {r.path: r for r in got.collect()}
    assert {p: r.skip for p, r in rows.items()} == {"src/a.py": None, "src/gen.rs": None, "vendor/b.go": "vendor", ".env": "secret_like", "docs/c.md": "secondary", "big.txt": "too_large", "out/d.txt": "excluded", "Cargo.toml": None}
    assert rows["src/a.py"].language == "python" and rows["src/gen.rs"].generated and rows[".env"].text is None
    assert {r.skip: r.n for r in R.skip_counts(got).collect()}["vendor"] == 1 and [r.system for r in R.build_systems(got).collect()] == ["cargo"]


def test_git_log(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=me", "-c", "user.email=m@e", *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "a.txt").write_text("1\n3\n4\n")
    git("commit", "-qam", "second: change")
    log = R.git_log(spark, str(tmp_path)).collect()
    assert [(r.summary, [(t.kind, t.path) for t in r.touches]) for r in log] == [("second: change", [("modified", "a.txt")]), ("first", [("added", "a.txt")])]
    hunks = R.git_log(spark, str(tmp_path), 1, patches=True).first().hunks
    assert [(h.path, h.old_start, h.new_start, h.new_end) for h in hunks] == [("a.txt", 2, 2, 3)]


def test_index_versions(spark, tmp_path):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "file_id int, path string")
    R.save_index({"files": files}, str(tmp_path), 0)
    R.replace_files(R.load_index(spark, str(tmp_path)), {"files": spark.createDataFrame([(2, "c"), (3, "d")], "file_id int, path string")}, spark.createDataFrame([(2,), (3,)], "file_id int"), str(tmp_path), 1)
    assert {r.path for r in R.load_index(spark, str(tmp_path))["files"].collect()} == {"a", "c", "d"}
    assert {r.path for r in R.load_index(spark, str(tmp_path), 0)["files"].collect()} == {"a", "b"}
    assert R.partial_update((1, "full"), (1, "full")) and not R.partial_update(None, (1, "full"))


def test_policy_file(spark, tmp_path):
    text = '[[components]]\nid = "ui"\nglobs = ["ui/**"]\n[[dependencies]]\nfrom = "ui"\nto = "*"\naction = "allow"\n'
    assert R.policy(text) == {"components": [("ui", "ui/**")], "rules": [("ui", "*", "allow")], "public_api": [], "exemptions": []}
    with pytest.raises(ValueError):
        R.policy(text.replace('from = "ui"', 'from = "db"'))
    (tmp_path / "CODEOWNERS").write_text("# x\n*.md @docs\n!a @b\n/src/ someone\n/lib/ a@b.c # note @no\n")
    assert R.owners_of(spark, str(tmp_path)) == [("*.md", ["@docs"]), ("/lib/", ["a@b.c"])]


def test_tasks(spark):
    a = K.anchors("Rename fooBar in src/x.rs for AB-12 like Heron_Base")
    assert a == {"primary": ["Rename", "fooBar"], "reference": ["Heron_Base"], "tickets": ["AB-12"], "paths": ["src/x.rs"]}
    assert K.search_terms("configured fooBar") == ["configured fooBar", "fooBar", "config", "config foobar"]
    top = spark.createDataFrame([("src/x.rs", "foo bar here")], "path string, text string")
    assert K.unmatched("fix fooBar and otherThing", top) == ["otherThing"]
    seeds = K.seeded(spark.createDataFrame([("a", 1.0)], "path string, score double"), spark.createDataFrame([("a", 9.0), ("b", 2.0), ("c", 0.5)], "path string, score double"), 2)
    assert [(r.path, r.score) for r in seeds.collect()] == [("b", 2.0), ("a", 1.0)]
    facts = spark.createDataFrame([("1", "s", "run cargo test in a_b", 1)], "fact_id string, source string, text string, created long")
    assert K.remember(facts, " new ", "me", "high", 2).count() == 2
    assert {(r.kind, r.value) for r in K.entity_links(facts, "fact_id", "text").collect()} == {("command", "cargo"), ("symbol", "a_b")}
    with pytest.raises(ValueError):
        K.remember(facts, "  ", "me", "high", 2)
    assert K.continuation("m", {"a": 1, "b": 2}) == K.continuation("m", {"b": 2, "a": 1}) != K.continuation("n", {"a": 1, "b": 2})


def test_contracts():
    made = K.plan("do it", [{"path": "a.py", "score": 1.0}], [{"path": "b.py"}, {"path": "a.py"}], [{"name": "t", "confidence": "high"}], 0.3, ["e1"], ["Foo"])
    assert made["risk"]["level"] == "medium" and made["risk"]["score"] == 0.45 and made["caution"] == ["b.py"]
    good = K.contract(made, ["make"], [{"rule": "r", "reason": "x", "evidence_refs": ["e1"]}], ["s"])
    assert K.contract_errors(good) == [] and json.dumps(good)
    bad = good | {"secondary_files": ["a.py", "/etc"], "validation_commands": [], "required_tests": [{"target": "", "reason": "x", "evidence_refs": ["e9"]}]}
    assert K.contract_errors(bad) == ["validation_commands: must not be empty", "secondary_files[1]: not a path of the repository", "primary_files: shares a.py with secondary_files", "required_tests[0].target: is required", "required_tests[0].evidence_refs: unknown e9"]
    assert "primary[1]{path,score}:\n  a.py,1.0" in K.render_plan(made)


def test_owner_tokens(spark):
    assert [O.owner_of(t) for t in ("@a,", "(x@y.z)", "x@y", "bob", "@", "@@")] == ["@a", "x@y.z", None, None, None, "@@"]
    row = spark.range(1).select(O.owner_tokens(F.lit("ask @One, (X@y.z) and @one; not a@b")).alias("o")).first()
    assert row.o == ["one", "x@y.z"]


def test_tiers(spark):
    symbols = spark.createDataFrame([(1, "parse", "a::parse", 1), (2, "parse", "b::parse", 2), (3, "render", "b::render", 2), (4, "tokenizer", "c::tokenizer", 3)], "symbol_id int, name string, qualified_name string, file_id int")
    imports = spark.createDataFrame([(5, "b.render", 2, None), (6, "x", None, None)], "file_id int, imported string, target_file int, target_symbol int")
    uses = spark.createDataFrame([(1, "", "parse"), (9, "b", "parse"), (5, "", "parse"), (9, "", "parse"), (9, "", "render"), (9, "", "tokenizers"), (9, "", "zz")], "file_id int, module string, token string")
    got = {(r.file_id, r.module, r.token): (r.strategy, r.status, r.symbol_id) for r in G.resolve_symbols(uses, symbols, imports).collect()}
    assert got == {
        (1, "", "parse"): ("same-file", "resolved", 1), (9, "b", "parse"): ("same-module", "resolved", 2), (5, "", "parse"): ("direct-import", "resolved", 2), (9, "", "parse"): ("unique-project-name", "ambiguous", None),
        (9, "", "render"): ("unique-project-name", "resolved", 3), (9, "", "tokenizers"): ("fuzzy-fallback", "resolved", 4), (9, "", "zz"): ("unresolved", "unresolved", None),
    }


def test_import_rules(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a/x.ts", "src/lib/util.ts", "pkg/m/__init__.py", "svc/h/one.go", "svc/h/two.go", "src/core.rs", "src/main/java/a/B.java", "base/only.ts")], "path string")
    rows = [(1, "src/a/y.ts", "typescript", "./x"), (2, "src/a/y.ts", "typescript", "@lib/util"), (3, "q.py", "python", "pkg.m"), (4, "g.go", "go", "ex.com/svc/h"), (5, "r.rs", "rust", "crate::core"), (6, "J.java", "java", "a.B"), (7, "z.ts", "typescript", "only"), (8, "z.ts", "typescript", "react"), (9, "z.ts", "typescript", "./gone"), (10, "z.ts", "typescript", "fs")]
    imports = spark.createDataFrame(rows, "import_id int, path string, language string, imported string")
    got = {r.import_id: (r.status, r.target, r.strategy) for r in G.resolve_imports(imports, files, aliases=[("@lib/*", ["../src/lib/*"]), ("@*", ["nothing/*"])], base_url="base", go_modules=("ex.com",)).collect()}
    assert got == {
        1: ("resolved", "src/a/x.ts", "relative-path"), 2: ("resolved", "src/lib/util.ts", "tsconfig-paths:@lib/*"), 3: ("resolved", "pkg/m/__init__.py", "python-module"), 4: ("ambiguous", None, "ambiguous"), 5: ("resolved", "src/core.rs", "rust-module"),
        6: ("resolved", "src/main/java/a/B.java", "java-package"), 7: ("resolved", "base/only.ts", "tsconfig-baseUrl"), 8: ("external", None, "manifest-package"), 9: ("unresolved", None, "unresolved"), 10: ("builtin", None, "builtin"),
    }


def test_hybrid_rules(spark):
    """A query's own file beats better scored tests; structural words of a path match nothing; leaving a signal out does."""
    none = None
    rows = [("tests/parser_test.rs", 3.0, none, none), ("src/parser.rs", 1.0, "Parser", "parser::Parser"), ("src/main.rs", 1.0, none, none)]
    df = spark.createDataFrame(rows, "path string, score double, name string, qualified_name string").selectExpr("path", "'' AS snippet", "name", "qualified_name", "'text' AS reason", "'' AS evidence", "score").withColumn("given", F.array().cast(Y.GIVEN))
    got = {r.path: r.fused for r in Y.fuse_for(df, "fix Parser in main").collect()}
    assert got["src/parser.rs"] > got["tests/parser_test.rs"] and got["src/main.rs"] == round(1 + 0.03 * 0.25, 6)
    assert {r.path: r.fused for r in Y.fuse_for(df, "fix Parser", "boundary_fit").collect()}["src/parser.rs"] == round(1 + 0.15, 6)
    facts = spark.createDataFrame([("src/parser.rs", "src/lexer.rs", "high")], "path string, target string, confidence string")
    marked = {r.path: r for r in Y.with_history(df, facts).collect()}
    assert set(marked) == {"tests/parser_test.rs", "src/parser.rs", "src/main.rs", "src/lexer.rs"} and "co-change" in marked["src/parser.rs"].evidence


def test_containing(spark):
    docs = spark.createDataFrame([(1, "x aa bb cc dd ee y"), (2, "aa bb cc dd\nee"), (3, "zaa bb cc dd eez"), (4, "aa bb"), (5, None)], "id int, t string")
    passages = spark.createDataFrame([(10, "aa bb cc dd ee"), (11, "a bb"), (12, "bb cc dd ee y q")], "query int, passage string")
    assert {(r.query, r.id) for r in S.containing(docs, "id", "t", passages).collect()} == {(10, 1), (10, 3), (11, 1), (11, 2), (11, 3), (11, 4)}


def test_ranks(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "id int, s double").repartition(5)
    got = {r.id: r["rank"] for r in rank_by(df, "s", "id").collect()}
    order = sorted(range(100), key=lambda i: (-(i % 7), i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_boundaries(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    cases = [("a/b", "a/b", True), ("a/**", "a/b/c", True), ("a/**", "ab/c", False), ("**/gen/**", "x/gen/y", True), ("**/gen/**", "gen", True), ("*.lock", "x.lock", True), ("a*c", "bac", True), ("a*c", "cab", False)]
    assert [one(X.boundary_matches(p, F.lit(v))) for p, v, _ in cases] == [w for _, _, w in cases]
    terms = X.impact_terms(spark.createDataFrame([("src/parser.rs", "ParserState"), ("src/parser.rs", "main"), ("x", "Other")], "path string, name string"), "src/parser.rs")
    assert [r.term for r in terms.collect()] == ["ParserState", "parser"]


def test_similar_changes_rules(spark):
    """A change that shares path, symbol and words beats one that shares words; former names count."""
    from datetime import datetime

    at = [datetime(2024, 1, d) for d in range(1, 6)]
    commits = spark.createDataFrame([(i, at[i], s) for i, s in enumerate(["rework parser cache", "rework parser", "other", "fix the", "cache"])], "commit_id int, committed_at timestamp, summary string")
    touches = spark.createDataFrame([(0, "p", None), (1, "q", None), (2, "r", "p"), (3, "s", None)], "commit_id int, path string, previous string")
    symbols = spark.createDataFrame([(0, 9, "m::Cache")], "commit_id int, symbol_id int, qualified_name string")
    edges = spark.createDataFrame([], "path string, other string, commits long, recency double, samples array<int>")
    hot = spark.createDataFrame([("p", 1.0)], "path string, hotspot double")
    got = C.similar_changes(commits, touches, symbols, edges, hot, "rework the parser cache", ["p"], ["cache"], 5).collect()
    assert [(r.commit_id, r.confidence) for r in got] == [(0, "high"), (2, "low"), (1, "low"), (4, "low")]
    assert got[0].score == round(0.24 + 0.42 + 0.35, 3) or got[0].score == 1.0


def test_engine(spark):
    e = Engine(Tables(spark, FOLDER))
    assert e.dispatch("list_files", {"limit": 5}).count() == 5 and e.dispatch("get_definition", {"name": "red widget"}).count() == 1
    assert e.node_for("NATION_3").first().id == "nation:3" and e.dispatch("get_callers", {"node": "nation:7", "limit": 3}).count() == 3
    with pytest.raises(ValueError):
        e.dispatch("drop_tables", {})
    assert [r.path for r in e.changed_files("--- a/x\n+++ b/y\n").collect()] == ["y"]
