"""Node and edge tables of the graph view, at file and at symbol grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..plans.kernels import scc
from ..schema import IMPORT_KINDS, CodeGraph, is_file, is_symbol, null_string, symbol_node
from .export import choose
from .traverse import folders

# Colours and weights of the view, and the files that stand for a module.
KIND_COLOURS = {
    "function": "#7c5cfc", "class": "#4f8ef7", "struct": "#5ba3f5", "interface": "#2dba8c", "trait": "#26a87e", "impl_method": "#9b7fe8", "method": "#9b7fe8", "enum": "#c4853a", "component": "#c0537a", "type": "#7a9fd4",
    "property": "#8897a8", "variable": "#8aa0b0", "const": "#96a8b8", "static": "#7d8fa0", "macro": "#a07ab0", "folder": "#6366f1", "module": "#5e8bc0", "file": "#6b6090",
}
LANGUAGE_COLOURS = {
    "typescript": "#3178C6", "tsx": "#3178C6", "javascript": "#E8D44D", "jsx": "#E8D44D", "rust": "#DEA584", "python": "#3572A5", "go": "#00ADD8", "java": "#B07219", "c": "#555555", "cpp": "#555555", "c++": "#555555",
    "css": "#563D7C", "scss": "#563D7C", "less": "#563D7C", "html": "#E34C26", "svelte": "#FF3E00", "vue": "#41B883", "ruby": "#CC342D", "php": "#4F5D95", "swift": "#F05138", "kotlin": "#A97BFF", "dart": "#00B4AB", "zig": "#F7A41D",
}
EDGE_COLOURS = {"Imports": "#1d4ed8", "ResolvedImport": "#1d4ed8", "Calls": "#7c3aed", "Extends": "#c2410c", "Contains": "#2d5a3d", "Implements": "#be185d", "HasDecorator": "#b45309"}
EDGE_WEIGHTS = {"Circular": 2.0, "Extends": 1.5, "Implements": 1.5, "Calls": 1.2, "Contains": 0.5}
MODULE_FILES = ["mod.rs", "lib.rs", "main.rs", "index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py"]


# Masses and sizes of the drawn view by kind, and how they change with the number of nodes.
MASSES = {"project": 50, "package": 30, "module": 20, "folder": 15, "file": 3, "class": 5, "interface": 5, "struct": 5, "trait": 5, "function": 2, "method": 2, "impl_method": 2, "enum": 2, "component": 2, "type": 1.5, "macro": 1.5}
MASS_FACTORS = [(5_000, 2.0), (1_000, 1.5)]
SIZES = {"project": 20, "package": 18, "module": 16, "folder": 15, "file": 7, "class": 5, "struct": 5, "interface": 5, "trait": 5, "enum": 4.5, "component": 4.5, "function": 4, "method": 4, "impl_method": 4, "type": 3.5, "macro": 3.5}
SIZE_FACTORS = [(50_000, 0.4, 1.0), (20_000, 0.5, 1.5), (5_000, 0.65, 2.0), (1_000, 0.8, 2.5)]  # over so many nodes: factor, least size


def _by_kind(kind: F.Column, values: dict[str, float], rest: float) -> F.Column:
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), F.lit(rest))


def node_mass(kind: F.Column, nodes: F.Column) -> F.Column:
    """The mass of a node of the drawn view."""
    factor = F.lit(1.0)
    for least, f in reversed(MASS_FACTORS):
        factor = F.when(nodes >= least, f).otherwise(factor)
    return _by_kind(kind, MASSES, 1.0) * factor


def scaled_size(kind: F.Column, nodes: F.Column) -> F.Column:
    """The size of a node of the drawn view: smaller in large graphs, down to a least size."""
    own = _by_kind(kind, SIZES, 3.0)
    out = own
    for over, f, least in reversed(SIZE_FACTORS):
        out = F.when(nodes > over, F.greatest(own * f, F.lit(least))).otherwise(out)
    return out


def edge_weight(kind: F.Column) -> F.Column:
    out = F.lit(1.0)
    for k, v in EDGE_WEIGHTS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _degrees(g: CodeGraph, of=is_file) -> DataFrame:
    """(id, degree) of the nodes of one sort; others are left out before they are dealt out and counted."""
    ends = g.all_edges().select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.where(of("id")).groupBy("id").agg(F.count("*").alias("degree"))


def node_size(degree: str = "degree") -> F.Column:
    return 2.0 + F.sqrt(F.coalesce(F.col(degree), F.lit(0)).cast("double")) * 3.0


def _finish_edges(e: DataFrame, in_cycle: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, kind) with colours; imports are circular where both ends are in some cycle (none: no imports)."""
    if in_cycle is None:
        e = e.withColumns({"a": F.lit(False), "b": F.lit(False)})
    else:
        e = e.join(in_cycle.select(F.col("path").alias("source"), F.lit(True).alias("a")), "source", "left").join(in_cycle.select(F.col("path").alias("target"), F.lit(True).alias("b")), "target", "left")
    circ = (F.col("kind") == "Imports") & F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))
    return e.select("source", "target", F.col("kind").alias("edge_type"), choose(F.col("kind"), EDGE_COLOURS, "#4a4060").alias("color"), circ.alias("is_circular"), F.when(circ, EDGE_WEIGHTS["Circular"]).otherwise(edge_weight(F.col("kind"))).alias("weight"))


def file_graph(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files and folders: key, label, kind, language, path, size, color, is_circular; imports and membership."""
    in_cycle = scc(g.file_imports()).select(F.col("node").alias("path"))
    module = file_name("path").isin(MODULE_FILES)
    f = g.files.join(_degrees(g), F.col("path") == F.col("id"), "left").join(in_cycle.withColumn("c", F.lit(True)), "path", "left")
    files = f.select(
        F.col("path").alias("key"), file_name("path").alias("label"), F.when(module, "module").otherwise("file").alias("kind"), "language", "path", node_size().alias("size"),
        F.when(module, KIND_COLOURS["module"]).otherwise(choose(F.col("language"), LANGUAGE_COLOURS, "#6B7280")).alias("color"), F.coalesce("c", F.lit(False)).alias("is_circular"),
    )
    tree, member = folders(g)
    inside = tree.where("parent IS NOT NULL").select(F.col("parent").alias("folder")).unionByName(member.select("folder")).groupBy("folder").agg(F.count("*").alias("n"))
    dirs = tree.join(inside, "folder", "left").select(
        F.concat(F.lit("folder:"), "folder").alias("key"), "label", F.lit("folder").alias("kind"), null_string().alias("language"), F.col("folder").alias("path"), (5.0 + 3.0 * F.sqrt(F.coalesce("n", F.lit(0)).cast("double"))).alias("size"), F.lit(KIND_COLOURS["folder"]).alias("color"), F.lit(False).alias("is_circular"),
    )
    imports = g.edges.where(F.col("kind").isin([*IMPORT_KINDS, "Imports"])).where(is_file("src") & is_file("dst")).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("Imports").alias("kind"))
    held = member.select(F.concat(F.lit("folder:"), "folder").alias("source"), F.col("path").alias("target"), F.lit("Contains").alias("kind")).unionByName(
        tree.where("parent IS NOT NULL").select(F.concat(F.lit("folder:"), "parent").alias("source"), F.concat(F.lit("folder:"), "folder").alias("target"), F.lit("Contains").alias("kind"))
    )
    return files.unionByName(dirs), _finish_edges(imports.unionByName(held), in_cycle)


def symbol_graph(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files and symbols; a symbol's key is path::name::line, with no path for a nested one."""
    return symbol_graph_nodes(g), symbol_graph_edges(g)


def _symbol_path() -> F.Column:
    return F.when(F.col("parent_id").isNull(), F.coalesce("file", F.lit(""))).otherwise("")


def _symbol_key() -> F.Column:
    return F.concat_ws("::", _symbol_path(), "name", F.col("line").cast("string"))


def symbol_graph_nodes(g: CodeGraph) -> DataFrame:
    in_cycle = scc(g.file_imports()).select(F.col("node").alias("path"))
    module = file_name("path").isin(MODULE_FILES)
    none, no_line = F.array().cast("array<string>"), F.lit(None).cast("int")
    files = g.files.join(in_cycle.withColumn("c", F.lit(True)), "path", "left").select(
        F.col("path").alias("key"), file_name("path").alias("label"), F.when(module, "module").otherwise("file").alias("kind"), "language", "path", F.lit(5.0).alias("size"),
        F.when(module, KIND_COLOURS["module"]).otherwise(KIND_COLOURS["file"]).alias("color"), F.coalesce("c", F.lit(False)).alias("is_circular"), none.alias("decorators"), no_line.alias("line"), no_line.alias("line_end"),
    )
    s = g.symbols.withColumn("id", symbol_node("symbol_id")).join(_degrees(g, is_symbol), "id", "left")
    symbols = s.select(
        _symbol_key().alias("key"), F.col("name").alias("label"), "kind", null_string().alias("language"), _symbol_path().alias("path"), node_size().alias("size"),
        choose(F.col("kind"), KIND_COLOURS, KIND_COLOURS["file"]).alias("color"), F.lit(False).alias("is_circular"), F.coalesce("decorators.name", none).alias("decorators"), "line", "line_end",
    )
    return files.unionByName(symbols)


def symbol_graph_edges(g: CodeGraph) -> DataFrame:
    """Edges by the keys of their ends. There are no imports among them, so none is circular and no cycle is looked for."""
    keys = g.files.select(F.col("path").alias("id"), F.col("path").alias("key")).unionByName(g.symbols.select(symbol_node("symbol_id").alias("id"), _symbol_key().alias("key")))
    e = g.all_edges().where(F.col("kind").isin("Contains", "Calls", "Extends", "Implements", "ChildOf", "HasDecorator"))
    e = e.join(keys.select(F.col("id").alias("src"), F.col("key").alias("source")), "src").join(keys.select(F.col("id").alias("dst"), F.col("key").alias("target")), "dst").select("source", "target", "kind")
    return _finish_edges(e)
