"""Questions answered by walking the graph: impact, cycles, flow, clusters, neighbourhoods, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import components, directory, file_name, of_language, under
from ..plans.kernels import bfs, label_propagation, scc, simple_paths
from ..plans.lineage import cut
from ..schema import CodeGraph, is_file, is_symbol, symbol_node, symbol_of
from .lookup import located


def _importers(g: CodeGraph) -> DataFrame:
    return g.file_imports().select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def confidence(depth: str = "depth", direct: str = "direct") -> F.Column:
    return F.when(F.col(direct) | (F.col(depth) == 1), "High").when(F.col(depth) <= 3, "Medium").otherwise("Low")


def basis(depth: str = "depth", direct: str = "direct") -> F.Column:
    kind = F.when(F.col(direct) | (F.col(depth) == 1), "direct caller").when(F.col(depth) <= 3, "transitive dependency").otherwise("deep transitive dependency")
    return F.concat(kind, F.lit(" at depth "), F.col(depth).cast("string"))


def impact(g: CodeGraph, symbols: DataFrame, max_depth: int | None = None, language: str | None = None, by: str | None = None) -> DataFrame:
    """(by, file_path, depth, confidence, basis): files that import the symbols' (symbol_id) files, however far away.

    by: a column of symbols that keeps questions apart, answered in one walk."""
    keys = [by] if by else []
    homes = located(g).join(symbols.select("symbol_id", *keys), "symbol_id").where("file_path IS NOT NULL")
    seeds = cut(homes.select(*keys, F.col("file_path").alias("node")).distinct())
    reached = bfs(seeds, _importers(g), max_depth, by).where("depth > 0")
    calls = g.edges.where("kind = 'Calls'").where(is_file("src")).join(symbols.select(*keys, symbol_node("symbol_id").alias("dst")), "dst").select(*keys, F.col("src").alias("node"), F.lit(True).alias("direct")).distinct()
    out = reached.join(calls, [*keys, "node"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    out = out.where(of_language("node", language))
    return out.select(*keys, F.col("node").alias("file_path"), "depth", confidence().alias("confidence"), basis().alias("basis")).orderBy(*keys, "depth", components("file_path"))


def risk(count: str, high: int = 20, medium: int = 5) -> F.Column:
    return F.when(F.col(count) > high, "HIGH").when(F.col(count) >= medium, "MEDIUM").otherwise("LOW")


def diff_impact(g: CodeGraph, changed: DataFrame, high: int = 20, medium: int = 5) -> tuple[DataFrame, DataFrame]:
    """For changed files (path): (changed_file, affected, risk), riskiest first, and (changed_file, file_path, depth, confidence).

    Files that the graph does not hold are passed over; a file without symbols affects none."""
    known = changed.select("path").distinct().join(g.files.select("path"), "path", "left_semi")
    seeds = located(g).join(known, F.col("file_path") == F.col("path"), "left_semi").select("symbol_id", F.col("file_path").alias("changed_file"))
    rows = cut(impact(g, seeds, by="changed_file"))
    counts = known.select(F.col("path").alias("changed_file")).join(rows.groupBy("changed_file").agg(F.count("*").alias("affected")), "changed_file", "left").fillna(0, ["affected"])
    tier = F.when(F.col("risk") == "HIGH", 0).when(F.col("risk") == "MEDIUM", 1).otherwise(2)
    return counts.withColumn("risk", risk("affected", high, medium)).orderBy(tier, F.desc("affected"), "changed_file"), rows.drop("basis")


def circular(g: CodeGraph, language: str | None = None) -> DataFrame:
    """(files): each cycle of files that import each other, sorted, its first repeated at the end."""
    members = scc(g.file_imports())
    out = members.groupBy("component").agg(F.collect_list("node").alias("files"))
    order = lambda a, b: F.when(F.split(a, "/") < F.split(b, "/"), -1).when(F.split(a, "/") > F.split(b, "/"), 1).otherwise(0)
    out = out.withColumn("files", F.array_sort("files", order))
    if language:
        from ..functions.paths import LANGUAGE_EXT, parse_language

        ext = "|".join(LANGUAGE_EXT[parse_language(language)])
        out = out.where(F.forall("files", lambda f: f.rlike(rf"\.({ext})$")))
    return out.select(F.concat("files", F.slice("files", 1, 1)).alias("files")).orderBy(F.split(F.col("files")[0], "/"))


def trace_flow(g: CodeGraph, entry: str, target: str, max_paths: int = 3, max_depth: int = 20) -> DataFrame:
    """(hops, depth, shared_dependency): paths over calls and imports from the first symbol named entry to any named target.

    If there is none: one row without hops, with the nearest node that both reach, if any."""
    e = g.edges.where(F.col("kind").isin("Calls", "ResolvedImport")).where((is_symbol("src") | is_file("src")) & (is_symbol("dst") | is_file("dst")))
    first = g.symbols.where(F.col("name") == entry).agg(F.min("symbol_id").alias("symbol_id")).where("symbol_id IS NOT NULL").select(symbol_node("symbol_id").alias("node"))
    targets = g.symbols.where(F.col("name") == target).select(symbol_node("symbol_id").alias("node"))
    e = cut(e.select("src", "dst").distinct())
    names = g.symbols.select(symbol_node("symbol_id").alias("node"), F.col("name").alias("label")).unionByName(g.files.select(F.col("path").alias("node"), file_name("path").alias("label")))
    named_of = lambda df: df.join(names.join(F.broadcast(df.select("node").distinct()), "node", "left_semi"), "node", "left")  # noqa: E731 - of a few nodes
    found = simple_paths(first, targets, e, max_depth, max_paths, ready=True)
    if not found.isEmpty():
        steps = named_of(found.select("hops", "depth", F.posexplode("hops").alias("i", "node")))
        named = steps.groupBy("hops", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("label", F.lit("?")).alias("label")))), lambda x: x["label"]).alias("names"))
        return named.orderBy("depth", "hops").select(F.col("names").alias("hops"), "depth", F.lit(None).cast("string").alias("shared_dependency"))
    a = bfs(first, e, max_depth, ready=True).where("depth > 0")
    b = targets.limit(0) if a.isEmpty() else bfs(targets, e, max_depth, ready=True).where("depth > 0").select("node")
    near = cut(a.join(b, "node", "left_semi").orderBy("depth", "node").limit(1))
    near = named_of(near).select(F.coalesce("label", F.lit("?")).alias("shared_dependency"))
    return near.select(F.array().cast("array<string>").alias("hops"), F.lit(0).alias("depth"), "shared_dependency")


def directory_label(path: str) -> F.Column:
    """The first directory after leading src and lib; core if there is none."""
    dirs = F.slice(components(path), 1, F.greatest(F.size(components(path)) - 1, F.lit(0)))
    rest = F.split(F.regexp_replace(F.concat_ws("/", dirs), "^(?:(?:src|lib)(?:/|$))+", ""), "/")
    return F.when(F.coalesce(rest[0], F.lit("")) == "", "core").otherwise(rest[0])


def cluster_members(g: CodeGraph, scope: str | None = None, rounds: int = 100) -> DataFrame:
    """(node, label) of contained symbols after label propagation over calls and nesting."""
    s = g.symbols.where("parent_id IS NULL AND file IS NOT NULL").where(under("file", scope)).select(symbol_node("symbol_id").alias("node"), directory_label("file").alias("label"))
    links = g.edges.where("kind = 'Calls'").unionByName(g.child_of())
    ids = s.select("node")
    links = links.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return label_propagation(s, links, rounds)


def clusters(g: CodeGraph, scope: str | None = None, rounds: int = 100) -> DataFrame:
    """(label, member_count, top_symbols): clusters, largest first, with their five symbols of most incoming edges."""
    m = cluster_members(g, scope, rounds)
    degree = g.all_edges().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    named = m.join(degree, "node", "left").fillna(0, ["n"]).withColumn("symbol_id", symbol_of("node")).join(g.symbols.select("symbol_id", "name"), "symbol_id")
    top = Window.partitionBy("label").orderBy(F.desc("n"), "name", "symbol_id")
    best = named.withColumn("r", F.row_number().over(top)).where("r <= 5").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("top_symbols"))
    return m.groupBy("label").agg(F.count("*").alias("member_count")).join(best, "label").orderBy(F.desc("member_count"), "label")


def symbol_neighbourhood(g: CodeGraph, symbol: str, depth: int) -> DataFrame:
    """(path): files with a symbol within depth steps of the named ones; all files if there is none."""
    e = g.edges.where(F.col("kind").isin("ResolvedImport", "Calls", "Extends", "Implements", "RustImport"))
    seeds = g.symbols.where(F.col("name") == symbol).select(symbol_node("symbol_id").alias("node"))
    near = bfs(seeds, e, depth).withColumn("symbol_id", symbol_of("node")).where("symbol_id IS NOT NULL")
    files = cut(g.symbols.where("parent_id IS NULL").join(near.select("symbol_id"), "symbol_id", "left_semi").select(F.col("file").alias("path")).where("path IS NOT NULL").distinct())
    return g.files.select("path") if files.isEmpty() else files


def neighbourhood(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within depth steps of nodes, edges taken both ways."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return bfs(nodes, both, depth)


def folders(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(folder, label, parent) of the folder tree and (path, folder) of files: folders with no files and one subfolder are merged into it.

    A chain's label joins its parts; files at the root have no folder. Depth, not size, bounds the prefixes of a path."""
    files = g.files.select("path", directory("path").alias("dir")).where("dir <> ''")
    parts = F.split("dir", "/")
    dirs = files.select("dir").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir")).distinct()
    dirs = dirs.withColumn("up", directory("dir"))
    sub = dirs.where("up <> ''").groupBy(F.col("up").alias("dir")).agg(F.count("*").alias("subs"))
    own = files.groupBy("dir").agg(F.count("*").alias("n"))
    d = dirs.join(sub, "dir", "left").join(own, "dir", "left").fillna(0, ["subs", "n"]).withColumn("merged", (F.col("subs") == 1) & (F.col("n") == 0))
    d = cut(d.select("dir", "up", "merged"))
    # a kept folder's ancestors, nearest first: the merged ones right above it go into its label
    kept = d.where("NOT merged").select(F.col("dir").alias("folder"))
    p = F.split("folder", "/")
    line = kept.select("folder", F.posexplode(F.transform(F.sequence(F.size(p) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).alias("i", "dir"))
    line = line.join(d.select("dir", "merged"), "dir", "left").where("NOT coalesce(merged, false)").groupBy("folder").agg(F.min_by("dir", "i").alias("parent"))
    label = F.when(F.col("parent") == "", F.col("folder")).otherwise(F.substring(F.col("folder"), F.length("parent") + 2, F.length("folder")))
    tree = line.select("folder", label.alias("label"), F.when(F.col("parent") != "", F.col("parent")).alias("parent"))
    return tree, files.select("path", F.col("dir").alias("folder"))
