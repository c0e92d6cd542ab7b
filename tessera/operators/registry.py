"""Resolution of uses to symbols by tiers, and of imports to files, as equi-joins on names, suffixes and grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identifiers as N
from tessera.functions import identity as I
from tessera.functions.paths import parent
from tessera.operators.rounds import cut

# How common a project-wide name may be; endings that an import may leave out; where Java sources lie.
COMMON_NAME, MOST_USES = 32, 80
ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java")
INDEXES = ("index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py", "mod.rs")
JAVA_ROOTS = ("src/main/java/", "src/test/java/")
TIERS = [("direct-import", "high", False), ("same-file", "high", False), ("same-module", "medium", False), ("unique-project-name", "medium", True), ("suffix-import-reachability", "low", True), ("fuzzy-fallback", "low", True)]


def token_uses(chunks: DataFrame, most: int = MOST_USES) -> DataFrame:
    """(chunk_id, file_id, line, token, is_call): the first `most` names of each chunk (chunk_id, file_id, text) that are no
    words of code; a call if a parenthesis follows."""
    lines = chunks.select("chunk_id", "file_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    found = lines.select("chunk_id", "file_id", "i", F.posexplode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_$]+(?:\s*\()?"), F.lit(0))).alias("j", "m"))
    named = found.withColumn("token", F.regexp_extract("m", r"^[\p{L}\p{N}_$]+", 0)).where(~N.is_keyword(F.col("token")) & (F.length("token") >= 2))
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("i", "j"))).where(F.col("_n") <= most)
    return first.select("chunk_id", "file_id", (F.col("i") + 1).cast("long").alias("line"), "token", F.col("m").endswith("(").alias("is_call"))


def resolve_symbols(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, module, token, strategy, status, candidates, symbol_id, confidence) of uses (file_id, module, token).

    symbols (symbol_id, name, qualified_name, file_id); imports (file_id, imported, target_file, target_symbol) that are
    resolved or not. The first tier with a candidate decides: what the file imports, the same file, the same module, the
    project's only symbol of the name, names that end so and are imported, names that hold or are held. Several candidates
    are ambiguous; a name of more than COMMON_NAME symbols is too common. Each distinct use is resolved once.
    """
    asked = uses.select("file_id", "module", "token").distinct()
    last = F.regexp_extract("qualified_name", r"(?:.*::)?(.*)$", 1)
    known = symbols.select("symbol_id", "name", "qualified_name", "file_id", N.module_of(F.col("qualified_name")).alias("module"), F.explode(F.array_distinct(F.array("name", last))).alias("token"))
    key, tiers = ["file_id", "module", "token"], []

    def counted(df: DataFrame, *by: str) -> DataFrame:
        """Candidates by what a use is joined on, so that a use meets one row however many symbols there are."""
        return df.groupBy(*by).agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))

    targets = imports.where("target_symbol IS NOT NULL").select("file_id", "imported", F.col("target_symbol").alias("symbol_id"))
    direct = targets.join(known.select("symbol_id", "token"), "symbol_id").unionByName(targets.select("symbol_id", "file_id", "imported", F.regexp_extract("imported", r"[^/.:]*$", 0).alias("token")))
    files = imports.where("target_symbol IS NULL AND target_file IS NOT NULL").select("file_id", "target_file").distinct().join(known.select(F.col("file_id").alias("target_file"), "symbol_id", "token"), "target_file")
    reached = direct.select("file_id", "token", "symbol_id").unionByName(files.select("file_id", "token", "symbol_id"))
    tiers.append(asked.join(counted(reached, "file_id", "token"), ["file_id", "token"]))
    tiers.append(asked.join(counted(known, "file_id", "token"), ["file_id", "token"]))
    tiers.append(asked.where("module <> ''").join(counted(known, "module", "token"), ["module", "token"]))
    tiers.append(asked.join(counted(symbols.withColumnRenamed("name", "token"), "token"), "token"))

    # symbols of the same names are one class, known by its least id: what names alone decide is asked once a class
    held = symbols.where("symbol_id IS NOT NULL").groupBy("symbol_id").agg(F.array_sort(F.collect_set(F.struct("name", "qualified_name"))).alias("names"))
    classes = held.groupBy("names").agg(F.min("symbol_id").alias("class"), F.count("*").alias("size"))
    named = classes.select("class", "size", F.explode("names").alias("x")).select("class", "size", "x.*")

    def of_classes(df: DataFrame, *by: str) -> DataFrame:
        return df.select(*by, "class", "size").distinct().groupBy(*by).agg(F.sum("size").alias("n"), F.min("class").alias("symbol_id"))

    # every ending of a dotted name that some import may be; a use then needs the name to end with its token
    dotted = named.select("class", "size", "qualified_name", F.replace("qualified_name", F.lit("::"), F.lit(".")).alias("d"))
    endings = dotted.select("class", "size", "qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("d")), lambda i: F.right("d", i))).alias("imported"))
    near = imports.select("file_id", "imported").distinct().join(endings, "imported").select("file_id", "class", "size", "qualified_name").distinct()
    ended = near.select("file_id", "class", "size", F.explode(F.transform(F.sequence(F.lit(0), F.length("qualified_name")), lambda i: F.right("qualified_name", i))).alias("token"))
    tiers.append(asked.join(of_classes(ended, "file_id", "token"), ["file_id", "token"]))

    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(c, i, F.lit(4))))
    long_names, tokens = named.where(F.length("name") > 3).select("class", "size", "name").distinct(), asked.where(F.length("token") > 3).select("token").distinct()
    held_in = tokens.withColumn("g", F.left("token", F.lit(4))).join(long_names.withColumn("g", F.explode(grams(F.col("name")))), "g").where(F.col("name").contains(F.col("token")))
    holds = tokens.withColumn("g", F.explode(grams(F.col("token")))).join(long_names.withColumn("g", F.left("name", F.lit(4))), "g").where(F.col("token").contains(F.col("name")))
    alike = held_in.select("token", "class", "size").unionByName(holds.select("token", "class", "size"))
    tiers.append(asked.join(of_classes(alike, "token"), "token"))

    ordered = [t.select(*key, F.lit(i).alias("tier"), "n", "symbol_id") for i, t in enumerate(tiers)]
    best = reduce(DataFrame.unionByName, ordered).groupBy(*key).agg(F.min_by(F.struct("tier", "n", "symbol_id"), "tier").alias("b"))
    out = asked.join(best, key, "left")
    tier, n = F.col("b.tier"), F.coalesce("b.n", F.lit(0))
    common = (tier == 3) & (n > COMMON_NAME)
    name = F.when(common, "common-name-cap").otherwise(F.coalesce(F.get(F.array(*[F.lit(t[0]) for t in TIERS]), tier), F.lit("unresolved")))
    sure = F.when(n == 1, F.get(F.array(*[F.lit(t[1]) for t in TIERS]), tier)).otherwise("low")
    status = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return out.select(*key, name.alias("strategy"), status.alias("status"), n.cast("long").alias("candidates"), F.when(n == 1, F.col("b.symbol_id")).alias("symbol_id"), sure.alias("confidence"))


def use_facts(uses: DataFrame, resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, line, edge_type, symbol_id, confidence): CALLS and REFERENCES of uses that are resolved, by line of the file."""
    starts = chunks.select("chunk_id", "start_line")
    hits = uses.join(resolved.where("symbol_id IS NOT NULL"), ["file_id", "module", "token"]).join(starts, "chunk_id")
    edge = F.when(F.col("is_call"), "CALLS").otherwise("REFERENCES")
    return hits.select("chunk_id", (F.col("start_line") + F.col("line") - 1).alias("line"), edge.alias("edge_type"), "symbol_id", "confidence").distinct()


def candidate_paths(path: Column) -> Column:
    """The path, and for one without extension what it may stand for."""
    bare = ~F.regexp_extract(path, r"[^/]*$", 0).rlike(r".\.")
    return F.when(bare, F.concat(F.array(path), F.array(*[F.concat(path, F.lit(f".{e}")) for e in ENDINGS]), F.array(*[F.concat(path, F.lit(f"/{i}")) for i in INDEXES]))).otherwise(F.array(path))


def joined_path(base: Column, imported: Column) -> Column:
    """base/imported without `.` and with `..` taken back."""
    parts = F.split(F.concat_ws("/", F.nullif(base, F.lit("")), imported), "/")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases=(), base_url: str | None = None, go_modules=(), packages=()) -> DataFrame:
    """(import_id, status, candidates, target, strategy) of imports (import_id, path, language, imported) against files (path).

    Built-in modules come first. Then relative paths, aliases of a TypeScript configuration (longest prefix first, each
    (pattern, targets)) or its base folder, Go modules, and the modules of Rust, Python and Java give paths, each of which
    may stand for several files, or for those of a folder. One file: resolved; several: ambiguous; none: a package if it is
    one of `packages` or looks like one, else unresolved. Aliases, modules and packages are a manifest's few.
    """
    imported, language = F.col("imported"), F.col("language")
    # imports may be read out of texts, so they are written once
    rows = cut(imports.select("import_id", "path", "language", F.trim("imported").alias("imported")))
    script = language.isin("typescript", "javascript")
    relative = imported.startswith("./") | imported.startswith("../")
    nothing = F.array().cast("array<struct<path:string,strategy:string>>")
    one = lambda path, strategy: F.struct(path.alias("path"), F.lit(strategy).alias("strategy"))
    found = [F.when(relative, F.array(one(joined_path(parent(F.col("path")), imported), "relative-path"))).otherwise(nothing)]
    by_alias = F.when(script & F.lit(base_url is not None), F.array(one(joined_path(F.lit(base_url or ""), imported), "tsconfig-baseUrl"))).otherwise(nothing)
    for pattern, targets in sorted(aliases, key=lambda a: len(a[0].partition("*")[0])):
        inner = N.alias_capture(pattern, imported)
        of = [one(joined_path(F.lit(base_url or ""), F.replace(F.lit(t), F.lit("*"), inner)), f"tsconfig-paths:{pattern}") for t in targets]
        by_alias = F.when(script & inner.isNotNull(), F.array(*of)).otherwise(by_alias)
    found.append(by_alias)
    by_module = nothing
    for m in reversed(go_modules):
        by_module = F.when((language == "go") & imported.startswith(m), F.array(one(F.regexp_replace(F.substr(imported, F.lit(len(m) + 1)), "^/+", ""), f"go-module:{m}"))).otherwise(by_module)
    found.append(by_module)
    crate = F.replace(F.regexp_replace(imported, "^(crate|self)::", ""), F.lit("::"), F.lit("/"))
    found.append(F.when((language == "rust") & imported.contains("::"), F.array(one(F.concat(F.lit("src/"), crate), "rust-module"))).otherwise(nothing))
    dotted = F.replace(imported, F.lit("."), F.lit("/"))
    found.append(F.when(language == "python", F.array(one(dotted, "python-module"))).otherwise(nothing))
    found.append(F.when(language == "java", F.array(*[one(F.concat(F.lit(r), dotted), "java-package") for r in JAVA_ROOTS])).otherwise(nothing))

    # an import's stems in order, none twice, and for each the files that it may stand for, found once for all imports of it;
    # folders are counted before an import meets them. Sides grow with the files, whatever Catalyst takes them for, so none
    # is replicated
    stems = F.filter(F.transform(F.concat(*found), lambda c: F.struct(c["strategy"].alias("strategy"), I.repo_path(c["path"]).alias("stem"))), lambda c: c["stem"].isNotNull())
    tried = rows.where(~N.is_builtin(language, imported)).select("import_id", stems.alias("c"))
    tries = tried.select("import_id", F.col("c.stem").alias("stems"), F.explode("c").alias("t")).select("import_id", "stems", "t.*")
    asked, known = tries.select("stem").distinct(), files.select(F.col("path").alias("file")).distinct()
    exact = asked.select("stem", F.explode(candidate_paths(F.col("stem"))).alias("file")).join(known.hint("merge"), "file")
    folders = known.groupBy(parent(F.col("file")).alias("stem")).agg(F.count("*").alias("n"), F.min("file").alias("file")).where("stem <> ''")
    # a file that is in a folder tried by the same import is counted there
    among = F.col("folder").isNotNull() & F.array_contains("stems", F.col("folder"))
    single = tries.join(exact.withColumn("folder", F.nullif(parent(F.col("file")), F.lit(""))).hint("merge"), "stem").select("import_id", "strategy", "file", F.concat(F.lit("file:"), "file").alias("of"), F.when(among, 0).otherwise(1).cast("long").alias("n"))
    inside = tries.join(folders.hint("merge"), "stem").select("import_id", "strategy", "file", F.concat(F.lit("folder:"), "stem").alias("of"), "n")
    hits = single.unionByName(inside).groupBy("import_id", "of").agg(F.max("n").alias("n"), F.min("file").alias("file"), F.min("strategy").alias("strategy"))
    each = hits.groupBy("import_id").agg(F.sum("n").alias("n"), F.min("file").alias("file"), F.min("strategy").alias("strategy"))
    out = rows.select("import_id", "language", "imported").join(each.hint("merge"), "import_id", "left")
    n = F.coalesce("n", F.lit(0))
    package = N.package_of(imported).isin(*packages) if packages else F.lit(False)
    bare = ~relative & ~imported.startswith("/") & ~imported.contains("::")
    builtin = N.is_builtin(language, imported)
    status = F.when(builtin, "builtin").when(n == 1, "resolved").when(n > 1, "ambiguous").when(package | bare, "external").otherwise("unresolved")
    strategy = F.when(builtin, "builtin").when(n == 1, F.col("strategy")).when(n > 1, "ambiguous").when(package | bare, "manifest-package").otherwise("unresolved")
    return out.select("import_id", status.alias("status"), F.when(builtin, 0).otherwise(n).cast("long").alias("candidates"), F.when(~builtin & (n == 1), F.col("file")).alias("target"), strategy.alias("strategy"))


def import_symbols(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(import_id, target_symbol): the one symbol of the resolved file that the import's last part names."""
    named = resolved.where("target IS NOT NULL").select("import_id", "target", N.last_part(F.col("imported")).alias("part"))
    hits = named.join(symbols.select(F.col("path").alias("target"), "symbol_id", "name", "qualified_name"), "target")
    fit = hits.where((F.col("name") == F.col("part")) | F.col("qualified_name").endswith(F.col("part")))
    return fit.groupBy("import_id").agg(F.count("*").alias("n"), F.min("symbol_id").alias("target_symbol")).where("n = 1").select("import_id", "target_symbol")


def import_facts(resolved: DataFrame) -> DataFrame:
    """(import_id, edge_type, target_kind, target): what a resolution says: a file, or a package."""
    file, package = F.col("status") == "resolved", F.col("status") == "external"
    rows = resolved.where(file | package)
    return rows.select("import_id", F.when(file, "IMPORTS").otherwise("DEPENDS_ON").alias("edge_type"), F.when(file, "file").otherwise("package").alias("target_kind"), F.when(file, F.col("target")).otherwise(N.package_of(F.col("imported"))).alias("target"))
