"""Lookups: find, refs, context, imports, decorators, rename, structure, file summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import components, file_name, of_language, parse_language, under
from ..schema import CodeGraph, is_file, is_symbol, join_sparse, null_string, symbol_node, symbol_of
from .decorators import with_frameworks


def check_regex(spark, pattern: str) -> None:
    """An invalid pattern is an error before any table is read."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e.java_exception.getMessage() if hasattr(e, 'java_exception') else e}") from None


def placed(g: CodeGraph, own: DataFrame | None = None) -> DataFrame:
    """Symbols (own: these of them) with file_path: a nested symbol's file is its parent's."""
    parents = g.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("file").alias("parent_file"))
    return join_sparse(g.symbols if own is None else own, parents, "parent_id", F.col("symbol_id")).withColumn("file_path", F.coalesce("file", "parent_file")).drop("parent_file")


def located(g: CodeGraph, own: DataFrame | None = None) -> DataFrame:
    """Symbols with file_path and language."""
    files = g.files.select(F.col("path").alias("file_path"), F.col("language").alias("language"), F.col("crate_name"))
    return placed(g, own).join(files, "file_path", "left")


def find(g: CodeGraph, pattern: str, ignore_case: bool = False, kinds: list[str] | None = None, file_prefix: str | None = None, language: str | None = None) -> DataFrame:
    """Symbols whose name the unanchored pattern matches, in order of path and line; language is the graph's own name."""
    pattern = f"(?i){pattern}" if ignore_case else pattern
    check_regex(g.spark, pattern)
    out = located(g, g.symbols.where(F.col("name").rlike(pattern)))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    out = out.where(F.col("file_path").isNotNull() & under("file_path", file_prefix))
    if language:
        out = out.where(F.col("language") == parse_language(language))
    return out.select(F.col("name").alias("symbol_name"), "kind", "file_path", "line", "line_end", "col", "is_exported", "is_default", "visibility", "decorators").orderBy(components("file_path"), "line")


def match_symbols(g: CodeGraph, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(name, ids) of names that the pattern matches."""
    pattern = f"(?i){pattern}" if ignore_case else pattern
    check_regex(g.spark, pattern)
    return g.symbols.where(F.col("name").rlike(pattern)).groupBy("name").agg(F.array_sort(F.collect_list("symbol_id")).alias("ids")).orderBy("name")


def refs(g: CodeGraph, symbols: DataFrame, kind: str | None = None, file: str | None = None, language: str | None = None) -> DataFrame:
    """(file_path, ref_kind, symbol_name, line): files that import a defining file, and callers of the symbols (symbol_id)."""
    where = placed(g).select("symbol_id", "file_path", F.col("name").alias("symbol_name"), "line")
    asked = g.symbols.join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    homes = placed(g, asked).select(F.col("file_path").alias("path")).distinct()
    imports = g.file_imports().join(homes.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path")).distinct()
    imports = imports.join(homes, "path", "left_anti").select(F.col("path").alias("file_path"), F.lit("Import").alias("ref_kind"), null_string().alias("symbol_name"), F.lit(None).cast("int").alias("line"))
    calls = g.edges.where("kind = 'Calls'").join(symbols.select(symbol_node("symbol_id").alias("dst")), "dst", "left_semi")
    by_symbol = calls.where(is_symbol("src")).select(symbol_of("src").alias("symbol_id")).join(where, "symbol_id").select("file_path", F.lit("Call").alias("ref_kind"), "symbol_name", "line")
    by_file = calls.where(is_file("src")).select(F.col("src").alias("file_path"), F.lit("Call").alias("ref_kind"), null_string().alias("symbol_name"), F.lit(None).cast("int").alias("line"))
    out = imports.unionByName(by_symbol).unionByName(by_file).where(under("file_path", file) & of_language("file_path", language))
    if kind:
        out = out.where(F.col("ref_kind") == kind)
    return out.orderBy(components("file_path"), "ref_kind", "line")


SECTIONS = ("definitions", "references", "callees", "callers", "extends", "implements", "extended_by", "implemented_by")


def context(g: CodeGraph, symbols: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(section, symbol_name, kind, file_path, line) around symbols (symbol_id); only the sections asked for are planned."""
    where = placed(g).select("symbol_id", F.col("name").alias("symbol_name"), "kind", "file_path", "line").where("file_path IS NOT NULL")
    own = where.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi")
    ids = own.select(symbol_node("symbol_id").alias("node"))
    parts = []

    def ends(kind: str, near: str, far: str, seeds: DataFrame) -> DataFrame:
        e = g.edges.where(F.col("kind") == kind).join(seeds.withColumnRenamed("node", near), near, "left_semi")
        return e.where(is_symbol(far)).select(symbol_of(far).alias("symbol_id")).distinct().join(where, "symbol_id")

    for s in sections:
        if s == "definitions":
            part = own
        elif s == "references":
            r = refs(g, symbols)
            part = r.select("symbol_name", F.col("ref_kind").alias("kind"), "file_path", "line")
        elif s == "callees":
            homes = own.select(F.col("file_path").alias("node"))
            part = ends("Calls", "src", "dst", ids.unionByName(homes).distinct())
        elif s == "callers":
            part = ends("Calls", "dst", "src", ids)
        else:
            kind = "Extends" if s.startswith("extend") else "Implements"
            part = ends(kind, "dst", "src", ids) if s.endswith("_by") else ends(kind, "src", "dst", ids)
        parts.append(part.select(F.lit(s).alias("section"), "symbol_name", "kind", "file_path", "line").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", components("file_path"), "line", "symbol_name")


def file_imports(g: CodeGraph, paths: DataFrame | None = None) -> DataFrame:
    """(file_path, specifier, category, is_reexport, seq) of files (path; none: all), in edge order; unresolved ones are left out."""
    e = g.edges.where(F.col("kind").isin("ResolvedImport", "ReExport", "BarrelReExportAll", "RustImport")).where(is_file("src"))
    if paths is not None:
        e = e.join(paths.select(F.col("path").alias("src")), "src", "left_semi")
    crates = g.files.select("path", "crate_name")
    e = e.join(crates.select(F.col("path").alias("src"), F.col("crate_name").alias("own")), "src", "left").join(crates.select(F.col("path").alias("dst"), F.col("crate_name").alias("other")), "dst", "left")
    head = F.element_at(F.split("specifier", "::"), 1)
    by_target = F.when(F.col("dst").startswith("pkg:"), "External").when(F.col("dst").startswith("builtin:"), "Builtin").when(F.col("own") != F.col("other"), "Workspace").otherwise("Internal")
    by_use = F.when(head.isin("std", "core", "alloc"), "Builtin").when(head.isin("crate", "super", "self") | F.coalesce(head == F.col("own"), F.lit(False)), "Internal").otherwise("External")
    kind = F.col("kind")
    e = e.where(~((kind == "ResolvedImport") & (F.col("dst").startswith("unresolved:") | is_symbol("dst"))))
    return e.select(
        F.col("src").alias("file_path"),
        F.when(kind == "BarrelReExportAll", F.col("dst")).otherwise(F.col("specifier")).alias("specifier"),
        F.when(kind == "ResolvedImport", by_target).when(kind == "RustImport", by_use).otherwise("Internal").alias("category"),
        kind.isin("ReExport", "BarrelReExportAll").alias("is_reexport"),
        "seq",
    ).orderBy("file_path", "seq")


def imports_of(g: CodeGraph, path: str) -> DataFrame:
    """One file's imports; a file that is not in the graph is an error."""
    one = g.files.where(F.col("path") == path).select("path")
    if one.isEmpty():
        raise ValueError(f"no such file in the graph: {path}")
    return file_imports(g, one).drop("file_path")


def find_by_decorator(g: CodeGraph, pattern: str, language: str | None = None, framework: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols with a decorator that the pattern matches, case aside; names of our own (`__...`) are left out."""
    check_regex(g.spark, f"(?i){pattern}")
    own = lambda d: d["name"].rlike(f"(?i){pattern}") & ~d["name"].startswith("__")
    # only symbols with such a decorator are joined, not all with their decorators
    d = with_frameworks(located(g, g.symbols.where(F.exists("decorators", own)))).select("name", "kind", "file_path", "line", "line_end", "language", F.explode("decorators").alias("d"))
    d = d.where(own(F.col("d")))
    if language:
        d = d.where(of_language("file_path", language))
    if framework:
        d = d.where(F.col("d.framework") == framework)
    out = d.select(F.col("name").alias("symbol_name"), "kind", "file_path", "line", "line_end", F.col("d.name").alias("decorator_name"), F.col("d.args_raw").alias("decorator_args"), F.col("d.framework").alias("framework"), "language")
    return out.orderBy("file_path", "line", "symbol_name", "decorator_name").limit(limit)


def plan_rename(g: CodeGraph, symbol: str, new_name: str) -> DataFrame:
    """(file_path, line, old_text, new_text, note): definitions and references of a name, one row a place, definitions first."""
    named = g.symbols.where(F.col("name") == symbol)
    ids = named.select("symbol_id")
    own = placed(g, named).where("file_path IS NOT NULL").select("file_path", "line", F.lit(0).alias("rank"))
    used = refs(g, ids).select("file_path", F.coalesce("line", F.lit(0)).alias("line"), F.lit(1).alias("rank"))
    first = Window.partitionBy("file_path", "line").orderBy("rank")
    rows = own.unionByName(used).withColumn("r", F.row_number().over(first)).where("r = 1")
    note = F.when(F.col("line") == 0, "import site — verify manually")
    return rows.select("file_path", "line", F.lit(symbol).alias("old_text"), F.lit(new_name).alias("new_text"), note.alias("note")).orderBy(components("file_path"), "line")


def structure(g: CodeGraph, path: str | None = None, depth: int = 3) -> DataFrame:
    """(parent, depth, node_type, name, kind_tag, symbols, count) rows of the tree below path, directories first.

    Below the depth a directory has one Truncated row with the number of its entries at that level."""
    files = g.files.where(under("path", path))
    skip = 0 if not path or path == "." else len(path.rstrip("/").split("/"))
    parts = F.slice(components("path"), skip + 1, 10_000)
    f = files.withColumn("parts", parts).where(F.size("parts") > 0)
    at = F.size("parts")
    syms = g.symbols.where("parent_id IS NULL").select("file", F.struct("name", "kind", "visibility").alias("s")).groupBy("file").agg(F.array_sort(F.collect_list("s")).alias("symbols"))
    leaves = f.where(at <= depth).join(syms, F.col("path") == F.col("file"), "left")
    source = F.col("kind") == "Source"
    kinds = "array<struct<name: string, kind: string, visibility: string>>"
    leaves = leaves.select(
        F.array_join(F.slice("parts", 1, at - 1), "/").alias("parent"), (at - 1).alias("depth"), F.when(source, "SourceFile").otherwise("NonParsedFile").alias("node_type"), F.element_at("parts", -1).alias("name"),
        F.when(~source, F.lower("kind")).alias("kind_tag"), F.when(source, F.coalesce("symbols", F.array().cast(kinds))).alias("symbols"), F.lit(None).cast("long").alias("count"),
    )
    dirs = f.where(at > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(at - 1, F.lit(depth))), lambda i: F.slice("parts", F.lit(1), i))).alias("d")).distinct() if depth > 0 else f.where("false").select(F.col("parts").alias("d"))
    dirs = dirs.select(F.array_join(F.slice("d", 1, F.size("d") - 1), "/").alias("parent"), (F.size("d") - 1).alias("depth"), F.lit("Dir").alias("node_type"), F.element_at("d", -1).alias("name"), null_string().alias("kind_tag"), F.lit(None).cast(kinds).alias("symbols"), F.lit(None).cast("long").alias("count"))
    deep = f.where(at > depth).select(F.array_join(F.slice("parts", 1, depth) if depth else F.array().cast("array<string>"), "/").alias("parent"), F.element_at("parts", depth + 1).alias("entry"))
    cut = deep.groupBy("parent").agg(F.countDistinct("entry").alias("count")).select("parent", F.lit(depth).alias("depth"), F.lit("Truncated").alias("node_type"), F.lit("").alias("name"), null_string().alias("kind_tag"), F.lit(None).cast(kinds).alias("symbols"), "count")
    order = F.when(F.col("node_type") == "Dir", 0).otherwise(1)
    return leaves.unionByName(dirs).unionByName(cut).orderBy(F.split("parent", "/"), order, "name")


# Names that tell a file's role.
ENTRY_NAMES = ["main.rs", "main.ts", "main.js", "index.ts", "index.js", "app.ts", "app.js"]
ROOT_NAMES = ["lib.rs", "mod.rs"]
TYPE_KINDS = ["type", "interface", "struct", "enum", "trait"]
CALL_KINDS = ["function", "impl_method", "method"]


def role(path: str = "path", kind: str = "kind", reexports: str = "reexports", types: str = "types", calls: str = "calls", symbols: str = "symbol_count") -> F.Column:
    """Config, Test, EntryPoint, LibraryRoot, Types or Utility, the first that holds."""
    name = file_name(path)
    share = F.when(F.col(symbols) > 0, F.floor(F.col(types) * 100 / F.col(symbols))).otherwise(0)
    return (
        F.when(F.col(kind).isin("Config", "Ci"), "Config")
        .when(name.contains("test") | name.contains("spec") | F.concat(F.lit("/"), F.col(path)).rlike("/(tests|__tests__)/"), "Test")
        .when(name.isin(ENTRY_NAMES) & (F.size(components(path)) <= 2), "EntryPoint")
        .when(name.isin(ROOT_NAMES) | (F.col(reexports) >= 3), "LibraryRoot")
        .when((F.col(types) > 0) & (F.col(calls) == 0) & (share >= 60), "Types")
        .otherwise("Utility")
    )


def graph_label(importers: str = "importer_count", imports: str = "import_count") -> F.Column:
    i, o = F.col(importers), F.col(imports)
    return F.when(i >= 5, "Hub").when(i == 0, "Leaf").when((i >= 2) & (o >= 3), "Bridge")


def file_summaries(g: CodeGraph) -> DataFrame:
    """One row a file: role, lines, symbols by kind, exports, imports, importers and label."""
    e = g.edges.where(F.col("kind").isin("ResolvedImport", "ReExport", "BarrelReExportAll", "RustImport"))
    out = e.where(is_file("src")).groupBy(F.col("src").alias("path")).agg(F.count_if(F.col("kind").isin("ResolvedImport", "RustImport")).alias("import_count"), F.count_if(F.col("kind").isin("ReExport", "BarrelReExportAll")).alias("reexports"))
    into = e.where(F.col("kind").isin("ResolvedImport", "BarrelReExportAll") & is_file("dst")).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importer_count"))
    by_kind = g.symbols.where("parent_id IS NULL").groupBy(F.col("file").alias("path"), "kind").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("is_exported"), F.struct("name", "kind"))).alias("x"))
    s = by_kind.groupBy("path").agg(
        F.sum("n").alias("symbol_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("symbol_kinds"), F.array_sort(F.flatten(F.collect_list("x"))).alias("exports"),
        F.sum(F.when(F.col("kind").isin(TYPE_KINDS), F.col("n")).otherwise(0)).alias("types"), F.sum(F.when(F.col("kind").isin(CALL_KINDS), F.col("n")).otherwise(0)).alias("calls"),
    )
    all_ = g.files.join(out, "path", "left").join(into, "path", "left").join(s, "path", "left").fillna(0, ["import_count", "reexports", "importer_count", "symbol_count", "types", "calls"])
    return all_.select(F.col("path").alias("relative_path"), role().alias("role"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("line_count"), "symbol_count", "symbol_kinds", "exports", "import_count", "importer_count", graph_label().alias("graph_label"))


def file_summary(g: CodeGraph, path: str) -> DataFrame:
    if g.files.where(F.col("path") == path).isEmpty():
        raise ValueError(f"no such file in the graph: {path}")
    one = g.with_(
        files=g.files.where(F.col("path") == path), symbols=g.symbols.where(F.col("file") == path), edges=g.edges.where((F.col("src") == path) | (F.col("dst") == path))
    )
    return file_summaries(one)

