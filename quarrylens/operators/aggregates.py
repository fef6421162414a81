"""Counts over the graph: kinds, project and crate statistics, languages, clones, packages, dead code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import components, file_name, under
from ..schema import KIND_CODES, CodeGraph, is_file, join_sparse, symbol_node
from .lookup import located


def symbols_by_kind(g: CodeGraph) -> DataFrame:
    return g.symbols.groupBy("kind").agg(F.count("*").alias("count"))


def project_stats(g: CodeGraph) -> DataFrame:
    """One wide row: symbols and files in one pass each, edges in one, joined as single rows."""
    s = located(g).select("symbol_id", "kind", "parent_id", "language")
    parents = g.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    s = join_sparse(s, parents, "parent_id", F.col("symbol_id"))
    k, lang, top = F.col("kind"), F.col("language"), F.col("parent_id").isNull()
    n = F.count_if
    symbols = s.agg(
        F.count("*").alias("symbol_count"),
        *[n(k == v).alias(c) for c, v in {"functions": "function", "classes": "class", "interfaces": "interface", "type_aliases": "type", "enums": "enum", "variables": "variable", "components": "component", "methods": "method", "properties": "property"}.items()],
        *[n((lang == "rust") & (k == v)).alias(f"rust_{c}") for c, v in {"fns": "function", "structs": "struct", "enums": "enum", "traits": "trait", "impl_methods": "impl_method", "type_aliases": "type", "consts": "const", "statics": "static", "macros": "macro"}.items()],
        n((lang == "python") & (top | k.isin("method", "function"))).alias("python_symbol_count"),
        *[n((lang == "python") & top & (k == v)).alias(f"python_{c}") for c, v in {"fns": "function", "classes": "class", "type_aliases": "type", "variables": "variable"}.items()],
        n((lang == "python") & ~top & k.isin("method", "function")).alias("python_methods"),
        n((lang == "go") & (top | (F.col("parent_kind") == "interface"))).alias("go_symbol_count"),
        *[n((lang == "go") & top & (k == v)).alias(f"go_{c}") for c, v in {"fns": "function", "structs": "struct", "interfaces": "interface", "consts": "const", "variables": "variable", "type_aliases": "type"}.items()],
        n((lang == "go") & (k == "method") & (top | (F.col("parent_kind") == "interface"))).alias("go_methods"),
    )
    f = F.col("kind")
    files = g.files.agg(
        F.count("*").alias("file_count"), n(F.col("language") == "python").alias("python_file_count"), n(F.col("language") == "go").alias("go_file_count"),
        n(f != "Source").alias("non_parsed_files"), *[n(f == v).alias(f"{v.lower()}_files") for v in ("Doc", "Config", "Ci", "Asset", "Other", "Source")],
    )
    resolved = F.col("kind") == "ResolvedImport"
    edges = g.edges.agg(
        n(resolved).alias("import_edges"), n(F.col("kind") == "RustImport").alias("rust_imports"), n(F.col("kind") == "ReExport").alias("rust_reexports"),
        n(resolved & F.col("dst").startswith("builtin:")).alias("builtin_usage_count"), n(resolved & F.col("dst").startswith("pkg:")).alias("external_usage_count"),
    )
    others = [g.packages.agg(F.count("*").alias("external_packages")), g.unresolved.agg(F.count("*").alias("unresolved_imports")), g.builtins.agg(F.count("*").alias("builtin_count"))]
    out = symbols  # each side below is a single row
    for one in (files, edges, *others):
        out = out.join(one, F.lit(True))
    return out


def crate_stats(g: CodeGraph) -> DataFrame:
    """One row a Rust crate; none unless there is more than one."""
    files = g.files.where("language = 'rust' AND crate_name IS NOT NULL")
    per = files.groupBy("crate_name").agg(F.count("*").alias("file_count"))
    s = located(g).where("language = 'rust' AND crate_name IS NOT NULL")
    k, top = F.col("kind"), F.col("parent_id").isNull()
    names = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type_alias": "type", "const": "const", "static": "static", "macro": "macro"}
    counts = s.groupBy("crate_name").agg(F.count("*").alias("symbol_count"), *[F.count_if(top & (k == v)).alias(f"{c}_count") for c, v in names.items()], F.count_if(k == "impl_method").alias("impl_method_count"))
    many = per.agg((F.count("*") > 1).alias("many"))
    cols = [f"{c}_count" for c in names] + ["impl_method_count", "symbol_count"]
    return per.join(counts, "crate_name", "left").fillna(0, cols).join(many, F.col("many")).drop("many")


def languages(g: CodeGraph) -> DataFrame:
    """(language, files, symbols), most files first."""
    s = g.symbols.where("parent_id IS NULL").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n"))
    return g.files.join(s, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols")).orderBy(F.desc("files"), "language")


def signatures(g: CodeGraph, scope: str | None = None) -> DataFrame:
    """Contained symbols with the five numbers of their structural signature."""
    e = g.all_edges()
    out = e.groupBy("src").agg(F.count("*").alias("outgoing"))
    into = e.groupBy("dst").agg(F.count("*").alias("incoming"))
    s = g.symbols.where("parent_id IS NULL AND file IS NOT NULL").where(under("file", scope)).withColumn("node", symbol_node("symbol_id"))
    s = s.join(out, F.col("node") == F.col("src"), "left").join(into, F.col("node") == F.col("dst"), "left")
    size = F.greatest(F.col("line_end") - F.col("line"), F.lit(0)).cast("long")
    return s.select("name", "kind", F.col("file"), "line", size.alias("body_size"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce(F.size("decorators"), F.lit(0)).cast("long").alias("decorator_count"))


def clones(g: CodeGraph, scope: str | None = None, min_group: int = 2, with_hash: bool = True) -> DataFrame:
    """One row a member of a group of min_group symbols or more with equal signatures; groups by size, then hash.

    Members stay rows: groups of any size are joined to their counts, never gathered."""
    s = signatures(g, scope)
    keys = ["kind", "body_size", "outgoing", "incoming", "decorator_count"]
    groups = s.groupBy(*keys).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= min_group)
    if with_hash:
        groups = groups.withColumn("hash", signature_hash("kind", "body_size", "outgoing", "incoming", "decorator_count"))
    text = F.format_string("kind=%s body=%d out=%d in=%d decorators=%d", *keys)
    out = s.join(groups, keys).withColumn("signature", text)
    return out.orderBy(F.desc("group_size"), *(["hash"] if with_hash else keys), components("file"), "line")


@F.pandas_udf(T.DecimalType(20, 0))
def signature_hash(kind: pd.Series, body: pd.Series, out: pd.Series, into: pd.Series, decorators: pd.Series) -> pd.Series:
    """Xor and multiply over the five numbers in 64 unsigned bits, which SQL arithmetic would overflow."""
    from decimal import Decimal

    h = np.full(len(kind), 0xCBF29CE484222325, np.uint64)
    with np.errstate(over="ignore"):
        for c in (kind.map(KIND_CODES).fillna(0), body, out, into, decorators):
            h = (h ^ c.to_numpy().astype(np.int64).view(np.uint64)) * np.uint64(0x100000001B3)
    return pd.Series([Decimal(int(x)) for x in h])


def package(path: str = "path", crate: str = "crate_name") -> F.Column:
    """The crate, else the first directory (below src/ the second component), else root."""
    c = components(path)
    first, second = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))
    by_dir = F.when((first == "src") & second.isNotNull(), F.regexp_replace(second, r"(\.rs)+$", "")).when(first != "src", first).otherwise("root")
    return F.coalesce(F.col(crate), by_dir)


def file_dependencies(g: CodeGraph) -> DataFrame:
    """(src, dst, n, label): dependency edges between different files, counted."""
    e = g.edges.where(F.col("kind").isin("ResolvedImport", "Calls", "Extends", "Implements", "BarrelReExportAll", "ReExport", "RustImport"))
    e = e.where(is_file("src") & is_file("dst") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return e.withColumn("label", F.when(F.col("n") == 1, "1 import").otherwise(F.concat(F.col("n").cast("string"), F.lit(" imports"))))


def package_dependencies(g: CodeGraph) -> DataFrame:
    """(src, dst, n): dependency edges between different packages."""
    p = g.files.select("path", package().alias("package"))
    e = file_dependencies(g).join(p.select(F.col("path").alias("src"), F.col("package").alias("a")), "src").join(p.select(F.col("path").alias("dst"), F.col("package").alias("b")), "dst")
    return e.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("n").alias("n"))


# Files and paths that count as used although nothing refers to them.
ENTRY_FILES = ["main.rs", "lib.rs", "index.ts", "index.js", "index.tsx", "index.jsx"]
TEST_DIRS = r"(^|/)(tests|_tests_|__tests__)/"


def unreachable_files(g: CodeGraph, scope: str | None = None) -> DataFrame:
    """Source files that no file imports and that are no entry or test file."""
    name = file_name("path")
    used = g.edges.where(F.col("kind").isin("ResolvedImport", "BarrelReExportAll")).select(F.col("dst").alias("path"))
    entry = name.isin(ENTRY_FILES) | F.col("path").rlike(TEST_DIRS) | name.rlike(r"_test\.(rs|ts)$") | name.rlike(r"\.(test|spec)\.") | (F.col("kind") != "Source")
    return g.files.where(under("path", scope) & ~entry).join(used, "path", "left_anti").select("path").orderBy(components("path"))


def unreferenced_symbols(g: CodeGraph, scope: str | None = None) -> DataFrame:
    """(path, name, kind, line): contained symbols without a caller that are no entry of their own."""
    called = g.edges.where("kind = 'Calls'").select(F.col("dst").alias("node"))
    s = g.symbols.where("parent_id IS NULL AND file IS NOT NULL").join(g.files.select(F.col("path"), "language"), F.col("file") == F.col("path")).where(under("path", scope))
    shown = F.when(F.col("language") == "rust", F.col("visibility").isin("pub", "pub(crate)")).otherwise(F.col("is_exported"))
    entry = ((F.col("name") == "main") & (F.col("kind") == "function")) | F.col("trait_impl").isNotNull() | shown | F.col("name").startswith("test_") | F.col("path").rlike(TEST_DIRS) | F.col("path").rlike(r"(_test\.(rs|ts)|\.(test|spec)\.ts)$")
    dead = s.where(~F.coalesce(entry, F.lit(False))).withColumn("node", symbol_node("symbol_id")).join(called, "node", "left_anti")
    return dead.select("path", "name", "kind", "line").orderBy(components("path"), "line")
