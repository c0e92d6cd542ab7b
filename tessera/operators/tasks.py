"""Tasks: what they name, the context that is found for them, plans, contracts and memory."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identifiers as N
from tessera.functions import scores as S
from tessera.functions.identifiers import any_of
from tessera.operators.context import cell
from tessera.operators.facts import plausible_test

# What introduces a model for a change, what anchors add to a result, how many validation targets a plan has.
MODELS = (" similar to ", " like ", " copy from ", " copied from ", " mirror ", " mirrored from ", " based on ", " reference ")
BOOSTS = {"primary": (0.65, 0.85), "reference": (0.25, 0.65), "place": (0.35, 0.75)}
MOST_TESTS, MEMORY_SCAN = 8, 500
TICKET = re.compile(r"[A-Z]{2,}-[0-9]{2,}")


def named(text: str) -> list[str]:
    """Names that someone gave, in a text, each once: mixed case, separators, or digits beside capitals; not tickets."""
    out = []
    for token in (t.strip("-") for t in re.split(r"[^A-Za-z0-9_-]", text)):
        has = lambda p, t=token: re.search(p, t)
        if len(token) >= 3 and not TICKET.fullmatch(token) and (has("[a-z]") and has("[A-Z]") or has("[_-]") or has("[0-9]") and has("[A-Z]")):
            out.append(token)
    return list(dict.fromkeys(out))


def anchors(task: str) -> dict[str, list[str]]:
    """A task's names on the side that is edited and on the side of the model, and its tickets and paths."""
    low = task.lower()
    at = min((low.find(m) for m in MODELS if m in low), default=len(task))
    everything, primary, reference = named(task), named(task[:at]), named(task[at:])
    primary = primary or everything[:1]
    reference += [x for x in everything if x not in primary and x not in reference]
    tokens = [re.sub(r"^[^A-Za-z0-9_/.-]+|[^A-Za-z0-9_/.-]+$", "", t) for t in task.split()]
    paths = [t.strip("/") for t in tokens if "/" in t or t.endswith(N.PATH_ENDINGS)]
    return {"primary": primary, "reference": reference, "tickets": list(dict.fromkeys(t for t in tokens if TICKET.fullmatch(t))), "paths": list(dict.fromkeys(filter(None, paths)))}


def search_terms(task: str) -> list[str]:
    """The task and what it names, each once: tickets, paths, names, and what its words stand for."""
    a = anchors(task)
    return list(dict.fromkeys([task, *(t for t in (*a["tickets"], *a["paths"], *a["primary"], *a["reference"], *N.alias_terms(task)) if len(t) >= 3)]))


def merged_results(found: DataFrame) -> DataFrame:
    """(path, score, reasons): results (path, score, reason) of several searches, the best score of each path."""
    return found.groupBy("path").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def boosted(results: DataFrame, task: str) -> DataFrame:
    """results (path, text, score, confidence) with what the task's anchors in path and text add: 0.65 for a name on the
    edited side, 0.25 for one of the model, 0.35 for a ticket or path; confidence is at least the anchor's."""
    a, low = anchors(task), F.lower(F.concat_ws(" ", "path", "text"))
    score, confidence = F.col("score"), F.col("confidence")
    for kind, values in (("primary", a["primary"]), ("reference", a["reference"]), ("place", [*a["tickets"], *a["paths"]])):
        more, least = BOOSTS[kind]
        for value in values:
            held = N.contains_anchor(low, F.lit(value))
            score = score + F.when(held, more).otherwise(0.0)
            confidence = F.when(held, F.greatest(confidence, F.lit(least))).otherwise(confidence)
    return results.withColumn("score", F.round(score, 6)).withColumn("confidence", confidence)


def unmatched(task: str, top: DataFrame) -> list[str]:
    """Names of the task that none of the first five results (path, text) holds."""
    names = named(task)
    rows = top.limit(5).select(F.lower(F.concat_ws(" ", "path", "text")).alias("t")).collect()  # five rows
    if not names or not rows:
        return []
    text = " ".join(r.t for r in rows)
    return [n for n in names if n.lower() not in text and " ".join(N.identifier_words(n)) not in text]


def seeded(primary: DataFrame, runtime: DataFrame, limit: int) -> DataFrame:
    """primary results and those files of runtime facts (path, score) that aren't among them, the best `limit`."""
    more = runtime.join(primary.select("path"), "path", "left_anti")
    return primary.select("path", "score").unionByName(more.select("path", "score")).orderBy(F.col("score").desc(), "path").limit(limit)


def plan_tests(tests: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """(test_id, file_id, name, confidence): plausible tests; of a file that has class-like names only those; the surest
    first, ties by name."""
    like = (F.length("name") > 8) & F.col("name").rlike(r"^\p{Lu}") & F.col("name").rlike(r"\p{Ll}")
    rows = tests.where(plausible_test(F.col("name"))).dropDuplicates(["test_id"]).withColumn("_c", like)
    rows = rows.withColumn("_any", F.max("_c").over(Window.partitionBy("file_id"))).where(F.col("_c") | ~F.col("_any"))
    return rows.orderBy(S.confidence_value(F.col("confidence")).desc(), "name", "test_id").limit(most).select("test_id", "file_id", "name", "confidence")


def entity_links(facts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value): files, tickets, commands and symbols that a text's words are, each once."""
    bare = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9_/.:-]+|[^A-Za-z0-9_/.:-]+$", ""))
    kind = lambda t: F.when(N.is_path_like(t), "file").when(N.is_ticket(t), "ticket").when(any_of(t.startswith(c) for c in ("cargo", "./", "npm", "pytest")), "command").when(t.contains("::") | t.contains("_") | (t.rlike("[a-z]") & t.rlike("[A-Z]")), "symbol")
    made = F.transform(F.filter(bare, lambda t: F.length(t) >= 3), lambda t: F.struct(kind(t).alias("kind"), t.alias("value")))
    found = F.array_distinct(F.filter(made, lambda e: e["kind"].isNotNull()))
    return facts.select(key, F.explode(found).alias("e")).select(key, "e.kind", "e.value")


def remember(facts: DataFrame, text: str, source: str, confidence: str, created: int) -> DataFrame:
    """facts (fact_id, source, text, created, ...) with one more, whose id is of its text, source and time."""
    text = text.strip()
    if not text:
        raise ValueError("a fact needs a text")
    key = "memory:" + hashlib.sha256(f"{text}:{source}:{created}".encode()).hexdigest()
    one = facts.sparkSession.createDataFrame([(key, source, text, created, confidence)], "fact_id string, source string, text string, created long, confidence string")
    return facts.unionByName(one, allowMissingColumns=True)


def recall(facts: DataFrame, query: str, limit: int = 100, scan: int = MEMORY_SCAN) -> DataFrame:
    """(fact_id, score, created): of the newest `scan` facts (fact_id, text, created, confidence) those that hold words or
    entities of the query: 0.25 and 0.08 a word, 0.45 and 0.15 an entity, a tenth of the confidence."""
    newest = facts.orderBy(F.col("created").desc(), "fact_id").limit(scan)
    words = [w.lower() for w in re.split("[^A-Za-z0-9]", query) if len(w) >= 3]
    low = F.lower("text")
    hits = reduce(Column.__add__, [F.when(low.contains(w), 1).otherwise(0) for w in words], F.lit(0))
    asked = entity_links(facts.sparkSession.createDataFrame([(query,)], "q string"), "q", "q").select("kind", "value").distinct()
    linked = entity_links(newest, "fact_id", "text").join(F.broadcast(asked), ["kind", "value"], "left_semi").groupBy("fact_id").agg(F.count("*").alias("links"))
    rows = newest.withColumn("hits", hits).join(linked, "fact_id", "left").withColumn("links", F.coalesce("links", F.lit(0))).where("hits > 0 OR links > 0")
    score = F.when(F.col("hits") > 0, 0.25 + 0.08 * F.col("hits")).otherwise(0.0) + F.when(F.col("links") > 0, 0.45 + 0.15 * F.col("links")).otherwise(0.0) + S.confidence_value(F.col("confidence")) * 0.1
    return rows.select("fact_id", F.round(score, 6).alias("score"), "created").orderBy(F.col("score").desc(), F.col("created").desc(), "fact_id").limit(min(limit, 100))


def compact_title(title: Column) -> Column:
    """A path with a line range as the file's name with the range; other titles as they are."""
    return F.when(title.rlike(r":[0-9-]*-[0-9-]*$"), F.regexp_extract(title, r"([^/]*)$", 1)).otherwise(title)


def retrieve(handles: DataFrame, handle: str) -> DataFrame:
    """What a compression handle (key, text) stands for."""
    return handles.where(F.col("key") == handle)


def continuation(method: str, params: dict) -> str:
    """A handle for the next page of a call."""
    return "okc_" + hashlib.sha256(f"{method}\0{json.dumps(params, sort_keys=True)}".encode()).hexdigest()[:16]


def plan(task: str, primary: list[dict], impacts: list[dict], tests: list[dict], risk: float, evidence: list[str], missing: list[str]) -> dict:
    """A plan from bounded lists: files to edit, files to edit with caution, tests, risk and how sure it is.

    Risk is 0.45 at least where names of the task were not found. Confidence is the level of plan_confidence()'s score.
    """
    score = 0.0 if not primary else max(risk, 0.45 if missing else 0.0)
    level = "unknown" if not primary else "high" if score > 0.6 else "medium" if score > 0.25 else "low"
    allowed = sorted({p["path"] for p in primary})
    caution = sorted({i["path"] for i in impacts} - set(allowed))
    return {"task": task, "primary": primary, "impacts": impacts, "tests": tests[:MOST_TESTS], "risk": {"level": level, "score": score, "missing": missing}, "allowed": allowed, "caution": caution, "evidence": sorted(set(evidence))}


def contract(made: dict, commands: list[str], constraints: list[dict], symbols: list[str]) -> dict:
    """A change contract from a plan; its id is of what it says."""
    body = {
        "task": made["task"], "evidence_refs": made["evidence"], "primary_files": made["allowed"], "secondary_files": made["caution"], "forbidden_files": [], "impacted_symbols": symbols,
        "required_tests": [{"target": t["name"], "reason": t.get("reason", "selected for the change"), "evidence_refs": made["evidence"][:1]} for t in made["tests"]],
        "architecture_constraints": constraints, "validation_commands": commands,
    }
    return {"id": "contract:" + hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest(), **body}


def contract_errors(c: dict) -> list[str]:
    """What is wrong with a contract: missing and repeated parts, paths that lead out, files in two lists, unknown evidence."""
    lists = ("evidence_refs", "primary_files", "impacted_symbols", "required_tests", "architecture_constraints", "validation_commands")
    out = [f"{k}: is required" for k in ("id", "task") if not str(c.get(k) or "").strip()] + [f"{k}: must not be empty" for k in lists if not c.get(k)]
    for k in ("evidence_refs", "primary_files", "secondary_files", "forbidden_files", "impacted_symbols"):
        values = c.get(k) or []
        out += [f"{k}: repeats {v}" for v in sorted({v for v in values if values.count(v) > 1})] + [f"{k}[{i}]: is empty" for i, v in enumerate(values) if not v.strip()]
    files = {k: c.get(k) or [] for k in ("primary_files", "secondary_files", "forbidden_files")}
    for k, paths in files.items():
        out += [f"{k}[{i}]: not a path of the repository" for i, p in enumerate(paths) if p.startswith("/") or ".." in re.split(r"[/\\]", p)]
    names = list(files)
    out += [f"{a}: shares {v} with {b}" for i, a in enumerate(names) for b in names[i + 1 :] for v in sorted(set(files[a]) & set(files[b]))]
    known = set(c.get("evidence_refs") or [])
    for k in ("required_tests", "architecture_constraints"):
        for i, entry in enumerate(c.get(k) or []):
            out += [f"{k}[{i}].{f}: is required" for f in ("target" if k == "required_tests" else "rule", "reason") if not str(entry.get(f) or "").strip()]
            refs = entry.get("evidence_refs") or []
            out += [f"{k}[{i}].evidence_refs: must not be empty"] * (not refs) + [f"{k}[{i}].evidence_refs: unknown {r}" for r in refs if r not in known]
    return out


def render_plan(made: dict) -> str:
    """A plan as lines: each list with its length and columns, then its rows."""
    def table(title: str, rows: list[dict], columns: list[str]) -> list[str]:
        return [f"{title}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(cell(str(r.get(c, ""))) for c in columns) for r in rows)]

    lines = [f"task: {cell(made['task'])}", f"risk: {made['risk']['level']} {made['risk']['score']:.2f}"]
    lines += table("primary", made["primary"], ["path", "score"]) + table("tests", made["tests"], ["name", "confidence"])
    return "\n".join([*lines, *table("caution", [{"path": p} for p in made["caution"]], ["path"])])
