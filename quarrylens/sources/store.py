"""Where graphs and vectors rest: Parquet tables with a version, and a registry of projects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CodeGraph

VERSION = 1
TABLES = ("files", "symbols", "edges", "packages", "builtins", "unresolved")
ALIAS = re.compile(r"[A-Za-z0-9-]{1,64}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _rename(spark: SparkSession, a: str, b: str) -> None:
    """Put a in b's place. What b held moves aside first and goes last, so that a crash loses neither."""
    p, q, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (a, b, b + ".old"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(q):
        fs.delete(old, True)
        if not fs.rename(q, old):
            raise OSError(f"cannot move {b} aside")
    if not fs.rename(p, q):
        raise OSError(f"cannot put {a} in its place")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash between the two moves of a replacement: what was there before comes back."""
    if not exists(spark, path) and exists(spark, path + ".old"):
        p, old = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(path + ".old")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, p)


def save_graph(g: CodeGraph, path: str, files: DataFrame | None = None, parsed: DataFrame | None = None) -> None:
    """Write the graph beside path, then put it in place; files (path, size, mtime) serve later comparisons, parse results later updates.

    Symbols are sorted by name and edges by their end within their files, so lookups skip row groups."""
    spark, tmp = g.spark, path.rstrip("/") + ".new"
    recover(spark, path.rstrip("/"))
    for name in TABLES:
        df = getattr(g, name)
        order = {"symbols": ["name"], "edges": ["kind", "dst"]}.get(name)
        (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(f"{tmp}/{name}")
    (files if files is not None else spark.createDataFrame([], "path string, size long, mtime long")).select("path", "size", "mtime").write.mode("overwrite").parquet(f"{tmp}/state")
    if parsed is not None:
        parsed.write.mode("overwrite").parquet(f"{tmp}/parsed")
    spark.createDataFrame([(VERSION,)], "version int").write.mode("overwrite").parquet(f"{tmp}/_meta_version")
    _rename(spark, tmp, path.rstrip("/"))


def load_graph(spark: SparkSession, path: str) -> tuple[CodeGraph, DataFrame] | None:
    """(graph, file states), or None if there is none of this version."""
    path = path.rstrip("/")
    recover(spark, path)
    if not exists(spark, f"{path}/_meta_version") or spark.read.parquet(f"{path}/_meta_version").first().version != VERSION:
        return None
    return CodeGraph(*[spark.read.parquet(f"{path}/{t}") for t in TABLES]), spark.read.parquet(f"{path}/state")


def load_parsed(spark: SparkSession, path: str) -> DataFrame | None:
    """The parse results saved with the graph at path, if any."""
    path = path.rstrip("/") + "/parsed"
    return spark.read.parquet(path) if exists(spark, path) else None


def staleness(old: DataFrame, new: DataFrame, rebuild_share: float = 0.1) -> tuple[DataFrame, bool]:
    """(path, change: added, modified or deleted) between two states, and whether a tenth or more of the files changed."""
    a, b = old.select("path", F.struct("size", "mtime").alias("x")), new.select("path", F.struct("size", "mtime").alias("y"))
    d = a.join(b, "path", "full_outer")
    d = d.withColumn("change", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(F.col("x") != F.col("y"), "modified"))
    counts = d.agg(F.count("change").alias("c"), F.count("*").alias("n")).first()
    return d.where("change IS NOT NULL").select("path", "change"), counts.n > 0 and counts.c >= rebuild_share * counts.n


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    if not exists(spark, path):
        raise ValueError(f"no vectors at {path}")
    v = spark.read.parquet(path)
    if not v.where(F.size("vec") != dimensions).isEmpty():
        raise ValueError(f"the vectors at {path} do not have {dimensions} dimensions")
    return v


class Registry:
    """Projects by alias: both aliases and paths are unique."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def list(self) -> list[tuple[str, str]]:
        recover(self.spark, self.path)
        return sorted((r.alias, r.path) for r in self.spark.read.parquet(self.path).collect()) if exists(self.spark, self.path) else []

    def _put(self, rows: list[tuple[str, str]]) -> None:
        self.spark.createDataFrame(rows, "alias string, path string").coalesce(1).write.mode("overwrite").parquet(self.path + ".new")
        _rename(self.spark, self.path + ".new", self.path)

    def add(self, alias: str, path: str) -> None:
        if not ALIAS.fullmatch(alias):
            raise ValueError("an alias has 1 to 64 letters, digits or dashes")
        rows = self.list()
        if any(a == alias or p == path for a, p in rows):
            raise ValueError("alias or path is already there")
        self._put([*rows, (alias, path)])

    def get(self, alias: str) -> str:
        return dict(self.list())[alias]

    def remove(self, alias: str) -> None:
        rows = self.list()
        if alias not in dict(rows):
            raise ValueError(f"no project {alias}")
        self._put([x for x in rows if x[0] != alias])
