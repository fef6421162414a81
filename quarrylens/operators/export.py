"""Graphs as text: DOT and Mermaid at three grains, with the filters, counts and warnings of an export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import glob_regex, under
from ..schema import CodeGraph, is_symbol, null_string, symbol_node
from .aggregates import file_dependencies, package
from .traverse import symbol_neighbourhood

# What an edge or symbol looks like.
DEPENDENCY = ["ResolvedImport", "Calls", "Extends", "Implements", "BarrelReExportAll", "ReExport", "RustImport"]
STYLES = {"ReExport": "style=dashed", "BarrelReExportAll": "style=dashed", "Calls": "style=solid color=blue", "Extends": "style=solid arrowhead=onormal", "Implements": "style=dashed arrowhead=onormal"}
FILLS = {"function": "#AED6F1", "impl_method": "#AED6F1", "struct": "#A9DFBF", "class": "#A9DFBF", "trait": "#F9E79F", "interface": "#F9E79F", "enum": "#F1948A", "type": "#D7BDE2", "const": "#FAD7A0", "static": "#FAD7A0", "variable": "#FAD7A0", "macro": "#FDFEFE"}
SHORT = {"function": "fn", "variable": "var", "impl_method": "impl fn"}
FILE_FILL = "#AED6F1"


def choose(c: F.Column, table: dict[str, str], other) -> F.Column:
    out = F.lit(other) if isinstance(other, str) else other
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def dot_id(c: F.Column) -> F.Column:
    s = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
    return F.when(s == "", "node").when(s.rlike("^[0-9]"), F.concat(F.lit("n"), s)).otherwise(s)


def mermaid_label(c: F.Column) -> F.Column:
    for a, b in (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("{", "&#123;"), ("}", "&#125;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@dataclass
class Export:
    granularity: str = "file"  # symbol, file or package
    root: str | None = None
    exclude: list[str] = field(default_factory=list)
    symbol: str | None = None
    depth: int = 1
    modules: DataFrame | None = None  # (path, module): module paths that symbol labels show


def visible_files(g: CodeGraph, p: Export) -> DataFrame:
    files = g.files.where(under("path", p.root))
    for pattern in p.exclude:
        files = files.where(~F.col("path").rlike(glob_regex(pattern)))
    if p.symbol:
        files = files.join(symbol_neighbourhood(g, p.symbol, p.depth), "path", "left_semi")
    return files


def _numbered(g: CodeGraph, p: Export) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visible files and symbols with their node names, and the edges between what is drawn: (src, dst, kind, n)."""
    files = visible_files(g, p)
    symbols = g.symbols.where("parent_id IS NULL").join(files.select(F.col("path").alias("file")), "file", "left_semi")
    f = files.select("path", "crate_name", F.concat(F.lit("n"), F.sha1("path").substr(1, 12)).alias("node"))
    s = symbols.select(symbol_node("symbol_id").alias("path"), "name", "kind", "file", F.concat(F.lit("n"), F.col("symbol_id").cast("string")).alias("node"))
    if p.granularity == "symbol":
        e = g.edges.where(F.col("kind").isin(DEPENDENCY)).where(is_symbol("src") & is_symbol("dst") & (F.col("src") != F.col("dst"))).select("src", "dst", "kind", F.lit(1).cast("long").alias("n"))
        nodes = s.select("path", "node")
    else:
        e = file_dependencies(g).select("src", "dst", null_string().alias("kind"), "n")
        nodes = f.select("path", "node")
    e = e.join(nodes.select(F.col("path").alias("src"), F.col("node").alias("a")), "src").join(nodes.select(F.col("path").alias("dst"), F.col("node").alias("b")), "dst")
    if p.granularity == "package":
        own = f.select(F.col("node"), package().alias("package"))
        e = e.join(own.select(F.col("node").alias("a"), F.col("package").alias("pa")), "a").join(own.select(F.col("node").alias("b"), F.col("package").alias("pb")), "b")
        e = e.where("pa <> pb").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("n").alias("n")).select("a", "b", null_string().alias("kind"), "n")
    return f, s, e.select("a", "b", "kind", "n")


def counts(g: CodeGraph, p: Export, mermaid: bool = False) -> DataFrame:
    """(node_count, edge_count, warnings): one row; nothing is cut."""
    f, s, e = _numbered(g, p)
    nodes = {"symbol": s.select("node"), "file": f.select("node"), "package": f.select(package().alias("node")).distinct()}[p.granularity]
    out = nodes.agg(F.count("*").alias("node_count")).join(e.agg(F.count("*").alias("edge_count")), F.lit(True))
    warn = F.array(
        F.when(F.lit(mermaid) & (F.col("edge_count") > 500), F.format_string("%d edges may not render well in Mermaid; use file granularity or DOT", "edge_count")),
        F.when(F.lit(p.granularity == "symbol") & (F.col("node_count") > 200), F.format_string("%d symbols are hard to read; use file or package granularity", "node_count")),
    )
    return out.withColumn("warnings", F.array_compact(warn))


def _label(s: DataFrame, p: Export, before: str, after: str) -> DataFrame:
    if p.modules is not None:
        s = s.join(p.modules.select(F.col("path").alias("file"), "module"), "file", "left")
    else:
        s = s.withColumn("module", null_string())
    note = F.when(F.col("module").isNotNull(), F.concat(F.lit(before), F.col("module"), F.lit(after))).otherwise("")
    return s.withColumn("label", F.concat("name", F.lit(" ("), choose(F.col("kind"), SHORT, F.col("kind")), F.lit(")"), note))


def dot_lines(g: CodeGraph, p: Export) -> DataFrame:
    """(part, key, line) rows of a DOT text; in order of part and key they are the file."""
    f, s, e = _numbered(g, p)
    spark = g.spark
    parts = [spark.createDataFrame([(0, "0", "digraph code {"), (0, "1", "    rankdir=TB;"), (0, "2", "    node [style=filled fontname=monospace];"), (9, "", "}")], "part int, key string, line string")]
    node = lambda df, label, fill, pad="    ": F.concat(F.lit(pad), F.col("node"), F.lit(' [label="'), label, F.lit('" fillcolor="'), fill, F.lit('"];'))
    if p.granularity == "symbol":
        s = _label(s, p, "\\n", "")
        parts.append(s.select(F.lit(1).alias("part"), F.col("node").alias("key"), node(s, F.col("label"), choose(F.col("kind"), FILLS, "#EAECEE")).alias("line")))
        parts.append(e.select(F.lit(2).alias("part"), F.concat_ws(">", "a", "b", "kind").alias("key"), F.concat(F.lit("    "), "a", F.lit(" -> "), "b", F.lit(" ["), choose(F.col("kind"), STYLES, "style=solid"), F.lit("];")).alias("line")))
    elif p.granularity == "file":
        parts.append(f.select(F.lit(1).alias("part"), F.col("path").alias("key"), node(f, F.col("path"), F.lit(FILE_FILL)).alias("line")))
        label = F.when(F.col("n") == 1, "1 import").otherwise(F.concat(F.col("n").cast("string"), F.lit(" imports")))
        parts.append(e.select(F.lit(2).alias("part"), F.concat_ws(">", "a", "b").alias("key"), F.concat(F.lit("    "), "a", F.lit(" -> "), "b", F.lit(' [label="'), label, F.lit('"];')).alias("line")))
    else:
        own = f.withColumn("package", package())
        order = Window.partitionBy("package").orderBy("path")
        own = own.withColumn("i", F.row_number().over(order))
        heads = own.select("package").distinct().select(F.lit(1).alias("part"), F.concat("package", F.lit("\t0")).alias("key"), F.concat(F.lit("    subgraph cluster_"), dot_id(F.col("package")), F.lit(' {\n        label="'), "package", F.lit('";\n        color=lightgrey;\n        style=filled;')).alias("line"))
        inner = own.select(F.lit(1).alias("part"), F.concat("package", F.lit("\t1"), F.col("path")).alias("key"), node(own, F.col("path"), F.lit(FILE_FILL), "        ").alias("line"))
        tails = own.select("package").distinct().select(F.lit(1).alias("part"), F.concat("package", F.lit("\t2")).alias("key"), F.lit("    }").alias("line"))
        anchors = own.where("i = 1").select("package", "node")
        e = e.join(anchors.select(F.col("package").alias("a"), F.col("node").alias("x")), "a").join(anchors.select(F.col("package").alias("b"), F.col("node").alias("y")), "b")
        links = e.select(F.lit(2).alias("part"), F.concat_ws(">", "a", "b").alias("key"), F.concat(F.lit("    "), "x", F.lit(" -> "), "y", F.lit(" [ltail=cluster_"), dot_id(F.col("a")), F.lit(" lhead=cluster_"), dot_id(F.col("b")), F.lit(' label="'), F.col("n").cast("string"), F.lit('"];')).alias("line"))
        parts += [heads, inner, tails, links]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.orderBy("part", "key")


def mermaid_lines(g: CodeGraph, p: Export) -> DataFrame:
    """The same for a Mermaid flow chart."""
    f, s, e = _numbered(g, p)
    parts = [g.spark.createDataFrame([(0, "0", "flowchart TB")], "part int, key string, line string")]
    if p.granularity == "symbol":
        s = _label(s, p, " (", ")")
        lab = mermaid_label(F.col("label"))
        body = F.when(F.col("kind").isin("struct", "class", "component", "trait", "interface"), F.concat(F.lit('(["'), lab, F.lit('" ])'))).when(F.col("kind") == "enum", F.concat(F.lit('{"'), lab, F.lit('" }'))).otherwise(F.concat(F.lit('["'), lab, F.lit('"]')))
        parts.append(s.select(F.lit(1).alias("part"), F.col("node").alias("key"), F.concat(F.lit("    "), "node", body).alias("line")))
        arrow = F.when(F.col("kind").isin("ReExport", "BarrelReExportAll", "Implements"), " -.-> ").otherwise(" --> ")
        parts.append(e.select(F.lit(2).alias("part"), F.concat_ws(">", "a", "b", "kind").alias("key"), F.concat(F.lit("    "), "a", arrow, "b").alias("line")))
    elif p.granularity == "file":
        parts.append(f.select(F.lit(1).alias("part"), F.col("path").alias("key"), F.concat(F.lit("    "), "node", F.lit('["'), mermaid_label(F.col("path")), F.lit('"]')).alias("line")))
        label = F.when(F.col("n") == 1, "1 import").otherwise(F.concat(F.col("n").cast("string"), F.lit(" imports")))
        parts.append(e.select(F.lit(2).alias("part"), F.concat_ws(">", "a", "b").alias("key"), F.concat(F.lit("    "), "a", F.lit(" -->|"), label, F.lit("| "), "b").alias("line")))
    else:
        names = f.select(package().alias("package")).distinct()
        parts.append(names.select(F.lit(1).alias("part"), F.col("package").alias("key"), F.concat(F.lit("    "), dot_id(F.col("package")), F.lit('["'), mermaid_label(F.col("package")), F.lit('"]')).alias("line")))
        parts.append(e.select(F.lit(2).alias("part"), F.concat_ws(">", "a", "b").alias("key"), F.concat(F.lit("    "), dot_id(F.col("a")), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), dot_id(F.col("b"))).alias("line")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.orderBy("part", "key")


def write_text(lines: DataFrame, path: str) -> None:
    """One text file of the lines in their order."""
    lines.coalesce(1).sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)


def compact(df: DataFrame, headline: str) -> DataFrame:
    """One `line` a row: a headline word, then the row's values."""
    return df.select(F.concat_ws(" ", F.lit(headline), *[F.col(c).cast("string") for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))
