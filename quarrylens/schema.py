"""The code graph as tables.

Edges name their ends by node id: a file by its path, a symbol as `s:<symbol_id>`, a package as `pkg:<name>`, a
builtin as `builtin:<name>`, an unresolved import as `unresolved:<uid>`. Membership (Contains), nesting (ChildOf)
and decoration (HasDecorator) follow from `symbols` and are not stored twice; `all_edges` adds them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECORATOR = "struct<name: string, object: string, attribute: string, args_raw: string, framework: string>"
FILES = "path string, language string, crate_name string, kind string, n_lines long"
SYMBOLS = (
    "symbol_id long, file string, parent_id long, name string, kind string, line int, col int, line_end int, "
    f"is_exported boolean, is_default boolean, visibility string, trait_impl string, decorators array<{DECORATOR}>"
)
EDGES = "src string, dst string, kind string, specifier string, seq long"
PACKAGES = "name string, version string"
BUILTINS = "name string"
UNRESOLVED = "uid long, specifier string, reason string"

# Symbol kinds with their codes in structural signatures.
KIND_CODES = {
    "function": 1, "class": 2, "interface": 3, "variable": 4, "type": 5, "enum": 6, "trait": 7, "method": 8,
    "struct": 9, "component": 10, "property": 11, "impl_method": 12, "const": 13, "static": 14, "macro": 15,
}
# Edge kinds.
IMPORT_KINDS = ("ResolvedImport", "BarrelReExportAll", "ConditionalImport", "SideEffectImport", "DotImport")
STRUCTURAL_KINDS = ("Contains", "Calls", "Extends", "Implements", "ChildOf", "HasDecorator")


@dataclass(frozen=True)
class CodeGraph:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    packages: DataFrame
    builtins: DataFrame
    unresolved: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> CodeGraph:
        return CodeGraph(*[spark.createDataFrame([], s) for s in (FILES, SYMBOLS, EDGES, PACKAGES, BUILTINS, UNRESOLVED)])

    def with_(self, **tables: DataFrame) -> CodeGraph:
        return replace(self, **tables)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def contains(self) -> DataFrame:
        return self.symbols.where("parent_id IS NULL AND file IS NOT NULL").select(F.col("file").alias("src"), symbol_node("symbol_id").alias("dst"), F.lit("Contains").alias("kind"), null_string().alias("specifier"), F.lit(-3).cast("long").alias("seq"))

    def child_of(self) -> DataFrame:
        return self.symbols.where("parent_id IS NOT NULL").select(symbol_node("symbol_id").alias("src"), symbol_node("parent_id").alias("dst"), F.lit("ChildOf").alias("kind"), null_string().alias("specifier"), F.lit(-2).cast("long").alias("seq"))

    def has_decorator(self) -> DataFrame:
        return self.symbols.select(symbol_node("symbol_id").alias("src"), symbol_node("symbol_id").alias("dst"), F.lit("HasDecorator").alias("kind"), F.explode("decorators.name").alias("specifier"), F.lit(-1).cast("long").alias("seq"))

    def all_edges(self) -> DataFrame:
        return self.edges.unionByName(self.contains()).unionByName(self.child_of()).unionByName(self.has_decorator())

    def file_imports(self) -> DataFrame:
        """(src, dst) of resolved imports between files."""
        return self.edges.where("kind = 'ResolvedImport'").where(is_file("src") & is_file("dst")).select("src", "dst")


def join_sparse(rows: DataFrame, table: DataFrame, key: str, place: F.Column) -> DataFrame:
    """rows left-joined with table (one row a key), where most rows hold no key: these are dealt out by place.

    In a plain left join all rows of a null key go to one task, which grows with the table."""
    own = rows.withColumn("__key", F.coalesce(F.col(key), place))
    return own.join(table.withColumnRenamed(key, "__one"), (F.col("__key") == F.col("__one")) & F.col(key).isNotNull(), "left").drop("__key", "__one")


def null_string() -> F.Column:
    return F.lit(None).cast("string")


def symbol_node(c: str) -> F.Column:
    return F.concat(F.lit("s:"), F.col(c).cast("string"))


def symbol_of(c: str) -> F.Column:
    """The symbol id of a node id; null for other nodes."""
    return F.when(F.col(c).startswith("s:"), F.substring(F.col(c), 3, 30)).try_cast("long")


def is_symbol(c: str) -> F.Column:
    return F.col(c).startswith("s:")


def is_file(c: str) -> F.Column:
    return ~F.col(c).rlike("^(s|pkg|builtin|unresolved):")
