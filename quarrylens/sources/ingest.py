"""From files to a code graph: parse, number, resolve, enrich."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.decorators import with_frameworks
from ..operators.lookup import located
from ..operators.resolve import Manifests, resolve
from ..plans.lineage import cut
from ..schema import DECORATOR, CodeGraph
from .parsers import parse_file
from .walk import cargo_crates, file_table, go_modules, node_workspaces, other_files, project_options, source_files, typescript_paths

_FLAT = f"name: string, kind: string, line: int, col: int, line_end: int, is_exported: boolean, is_default: boolean, visibility: string, trait_impl: string, decorators: array<{DECORATOR}>"
_SPEC = "struct<name: string, alias: string, is_default: boolean, is_namespace: boolean>"
PARSED = (
    f"path string, symbols array<struct<{_FLAT}, children: array<struct<{_FLAT}>>>>, imports array<struct<kind: string, level: int, module_path: string, specifiers: array<{_SPEC}>, line: int>>, "
    "exports array<struct<kind: string, names: array<string>, source: string>>, relationships array<struct<from_name: string, to_name: string, kind: string, line: int>>, "
    "rust_uses array<struct<path: string, is_pub_use: boolean>>, mods array<string>"
)
ROWS = 200


def parse_sources(files: DataFrame) -> DataFrame:
    """One row a file that parses (path, content): nested symbols, imports, exports, relationships, uses and modules."""
    schema = to_arrow_schema(T.StructType.fromDDL(PARSED))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                rows = []
                for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if (parsed := parse_file(path, content or b"")) is not None:
                        rows.append({"path": path, **parsed})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, PARSED)


def symbol_table(parsed: DataFrame) -> DataFrame:
    """Symbols with ids that follow from their place: a hash of path, line, column, name and kind."""
    own = lambda s: F.xxhash64("path", F.col(f"{s}.line"), F.col(f"{s}.col"), F.col(f"{s}.name"), F.col(f"{s}.kind"))
    fields = lambda s: [F.col(f"{s}.{c}").alias(c) for c in ("name", "kind", "line", "col", "line_end", "is_exported", "is_default", "visibility", "trait_impl", "decorators")]
    top = parsed.select("path", F.explode("symbols").alias("s"))
    kids = top.select("path", own("s").alias("parent_id"), F.explode("s.children").alias("k"))
    a = top.select(own("s").alias("symbol_id"), F.col("path").alias("file"), F.lit(None).cast("long").alias("parent_id"), *fields("s"))
    b = kids.select(own("k").alias("symbol_id"), F.lit(None).cast("string").alias("file"), "parent_id", *fields("k"))
    return a.unionByName(b).dropDuplicates(["symbol_id"])


def build(files: DataFrame, exclude: list[str] | None = None, languages: list[str] | None = None, ts_paths: dict[str, str] | None = None) -> tuple[CodeGraph, DataFrame]:
    """(graph, parse results) of a project's files (path, content, ...).

    The configuration file at the root adds to exclude; path patterns come from its tsconfig.json unless ts_paths are given."""
    spark = files.sparkSession
    exclude = [*(exclude or []), *project_options(files).exclude]
    ts_paths = typescript_paths(files) if ts_paths is None else ts_paths
    sources, others = source_files(files, exclude, languages), other_files(files, exclude)
    parsed = cut(parse_sources(sources))
    table = file_table(sources.join(parsed.select("path"), "path", "left_semi")).unionByName(file_table(others))
    g = CodeGraph.empty(spark).with_(files=cut(table), symbols=cut(symbol_table(parsed)))
    manifests = Manifests(node_workspaces(files), cargo_crates(files), go_modules(files), ts_paths)
    g = resolve(g, parsed, manifests)
    langs = located(g).select("symbol_id", "language")
    return g.with_(symbols=with_frameworks(g.symbols.join(langs, "symbol_id", "left")).drop("language")), parsed
