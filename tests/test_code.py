"""Code metrics against a plain reading of the rules, and name and score functions on hand-made values."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import identifiers as N
from tessera.functions import identity as I
from tessera.functions import paths as P
from tessera.functions import scores as S
from tessera.operators import metrics as M
from tessera.sources.bindings import CODE


def plain(name, text):
    low, words = text.lower(), re.findall(r"[a-z0-9_]+|[{}()?&|]", text.lower())

    def called(part):
        return part.count(f"{name}(") + part.count(f"{name} (") > 1 or f".{name}(" in part

    segments = [low[m.start() : m.start() + 500] for w in ("for ", "while ", "loop ") for m in re.finditer(w, low)]
    depth = most = 0
    pending, stack = False, []
    for w in words:
        if w in ("for", "while", "loop"):
            pending = True
        elif w == "{":
            depth += 1
            if pending:
                stack.append(depth)
                most, pending = max(most, len(stack)), False
        elif w == "}":
            stack, depth = [d for d in stack if d < depth], max(depth - 1, 0)
    inside = re.search(r"\(([^)]*)\)", text)
    chain = best = 0
    for c in text:
        chain = chain + 1 if c == "." else chain if re.match("[A-Za-z0-9_]", c) else 0
        best = max(best, chain)
    return {
        "cyclomatic": 1 + sum(w in M.BRANCHING for w in words), "loop_count": sum(w in M.LOOPING for w in words), "max_loop_depth": most, "recursive": called(low),
        "linear_scan_in_loop": any(p in s for s in segments for p in M.SCANS), "allocation_in_loop": any(p in s for s in segments for p in M.ALLOCATIONS),
        "recursion_in_loop": called(low) and any(called(s) for s in segments), "unguarded_recursion": called(low) and not any(g in low for g in M.GUARDS),
        "parameter_count": len([x for x in (inside[1] if inside else "").split(",") if x.strip() not in ("", "self", "&self")]), "max_access_depth": best,
        "blocking_calls": sum(low.count(p) for p in M.BLOCKING),
    }


def test_metrics(spark):
    texts = [(lang, text.replace("{k}", "3").replace("{m}", "3")) for lang, _, text in CODE]
    texts += [("x", "fn f(a, &self) { for x in y { while z { f(1); xs.iter().find(q); Vec::new() } } loop { f (2) } }"), ("x", ""), ("x", "select * from t; a.b.c.d ? x : y } } {")]
    names = ["fetch_3", "load3", "go3", "Do3", "go_3", "f", "", "q"]
    rows = [(i, n, t) for i, (n, (_, t)) in enumerate(zip(names, texts))]
    got = {r.symbol_id: r.asDict() for r in M.measured(spark.createDataFrame(rows, "symbol_id int, name string, text string")).collect()}
    for i, n, t in rows:
        want = plain(n.lower(), t) if n else plain("\0", t)
        assert {k: got[i][k] for k in want} == want, (n, t)
        assert got[i]["cognitive"] == want["cyclomatic"] + want["max_loop_depth"] + 2 * want["recursive"] + want["blocking_calls"]


def test_call_depth(spark):
    """Loop depth is passed up along calls, and cycles are told from chains."""
    depths = spark.createDataFrame([("a", 1), ("b", 0), ("c", 3), ("d", 0), ("e", 2), ("f", 0)], "symbol_id string, max_loop_depth int")
    called = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("f", "d")], "symbol_id string, callee string")
    got = {r.symbol_id: (r.transitive_loop_depth, r.recursive) for r in M.transitive_depth(depths, called).collect()}
    assert got == {"a": (3, False), "b": (3, False), "c": (3, False), "d": (2, True), "e": (2, True), "f": (2, True)}


def test_similar_pairs(spark):
    rows = [(i, [f"g{(i // 4) * 3 + j}" for j in range(8)]) for i in range(40)] + [(100, []), (101, ["z"])]
    df = spark.createDataFrame(rows, "id int, g array<string>")
    sets = {i: frozenset(g) for i, g in rows if g}
    reps = {}
    for i, g in sorted(sets.items()):
        reps.setdefault(g, i)
    want = {(reps[g], i, 1.0) for i, g in sets.items() if reps[g] != i}
    want |= {(a, b, round(len(x & y) / len(x | y), 6)) for x, a in reps.items() for y, b in reps.items() if a < b and len(x & y) / len(x | y) >= 0.4}
    assert {(r.a, r.b, r.similarity) for r in M.similar_pairs(df, "id", "g", 0.4).collect()} == want


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda *columns: list(row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_names(one):
    lit = F.lit
    assert one(N.normalized_identifier(lit("parseHTTPRequest_fast-x/y.z2Q")), N.module_of(lit("a::b::c")), N.module_of(lit("a")), N.package_of(lit("@s/p/q")), N.package_of(lit("lodash/fp"))) == ["parse httprequest fast x y z2 q", "a::b", "", "@s/p", "lodash"]
    assert one(N.query_matches_path(lit("fix tokenizer"), lit("src/tokenizers.rs")), N.query_matches_path(lit("main index"), lit("src/main.rs")), N.terms_match(lit("abc"), lit("abcd"))) == [True, False, False]
    assert one(N.query_identifiers(lit("Read fooBar, a_b")), N.named_identifiers(lit("see fooBar AB-12 x-1 Plain plain")), N.intent(lit("Add it")), N.intent(lit("why test")), N.intent(lit("why"))) == [["read foo bar a b", "read", "foo bar", "a b"], ["fooBar", "x-1", "Plain"], "code_change", "validation", "understanding"]
    assert N.alias_terms("configured defaults of histories") == ["config", "default", "history", "config default", "default history"]
    assert one(*[N.alias_capture(p, lit("@app/x/y")) for p in ("@app/*", "@app/x/y", "@lib/*", "@app/*/y", "@app/*/z")]) == ["x/y", "", None, "x", "x/y"]
    assert one(N.is_builtin(lit("go"), lit("net/http")), N.is_builtin(lit("go"), lit("a.b/c")), N.is_builtin(lit("python"), lit("os.path")), N.is_builtin(lit("typescript"), lit("node:fs")), N.is_builtin(lit("rust"), lit("std::io"))) == [True, False, True, True, True]


def test_ids(one):
    lit, q = F.lit, I.qualified_name
    assert one(q(lit("a/b/__init__.py"), lit("python"), lit(None).cast("string"), lit("f")), q(lit("src/main/java/x/Y.java"), lit("java"), lit(None).cast("string"), lit("Y")), q(lit("a/Y.java"), lit("java"), lit("p.q"), lit("m")), q(lit("a/b.go"), lit("go"), lit("main"), lit("F"))) == ["a::b::f", "x::Y", "p::q::Y::m", "main::F"]
    assert one(I.repo_path(lit("./a//b\\c")), I.repo_path(lit("/a")), I.repo_path(lit("a/../b")), I.target_node_id(lit("endpoint"), lit("GET /a:b")), I.target_node_id(lit("config_key"), lit(" a/b "))) == ["a/b/c", None, None, "route:http:GET:%2Fa%3Ab", "config:a%2Fb"]
    assert one(P.endpoint(lit("grpc a.b"))["protocol"], P.endpoint(lit("HTTP https://h/x?y"))["path"], P.endpoint(lit(":80"))["path"], P.endpoint(lit("https://h"))["path"]) == ["grpc", "/x", ":80", "/"]
    assert [P.byte_size(x) for x in ("12", "1 kb", "2MiB", "3gb", "7b")] == [12, 1024, 2 << 20, 3 << 30, 7] and P.truncated("aé", 2) == ("a", True)
    with pytest.raises(ValueError):
        P.byte_size("3 tons")


def test_scores(one):
    lit = F.lit
    full = [lit(x) for x in (2, 8, 1, 2, 1, 0, 2, 1)]
    assert one(F.round(S.plan_confidence(*full), 6), F.round(S.plan_confidence(*[lit(0)] * 8), 6)) == [1.0, 0.2625]
    assert one(S.ownership_signal(lit(1), lit(0), lit(3)), S.reviewer_signal(lit(5)), S.similar_signal(lit(0.1)), S.similar_signal(lit(None).cast("double")), S.message_metric(lit("a, p95_ms 12.5, x"), "p95_ms")) == [0.04, 0.1, 0.05, 0.0, 12.5]
    assert one(S.lower_confidence(lit("exact"), lit("medium")), S.merged_messages(lit("b\na"), lit("a\nc")), S.availability(lit(False), lit(True), lit(False)), S.similar_confidence(lit(0.6), lit(3))) == ["medium", "a\nb\nc", "inferred_from_ownership", "high"]
