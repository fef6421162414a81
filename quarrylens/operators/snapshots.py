"""Snapshots of a graph, their store, and differences between two of them."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CodeGraph, is_file, symbol_node

NAME = re.compile(r"[\w-]{1,64}")
KEEP = 10
SYMBOL = "struct<name: string, kind: string, line: int, caller_count: long, position: int>"


def snapshot(g: CodeGraph, name: str, created_at: int | None = None, root: str = "") -> DataFrame:
    """One row a file: counts of symbols, imports and importers, and its symbols with their callers."""
    into = g.edges.where(F.col("kind").isin("ResolvedImport", "BarrelReExportAll") & is_file("dst")).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importer_count"))
    out = g.edges.where("kind = 'ResolvedImport'").where(is_file("src")).groupBy(F.col("src").alias("path")).agg(F.count("*").alias("import_count"))
    callers = g.edges.where("kind = 'Calls'").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("caller_count"))
    s = g.symbols.where("parent_id IS NULL AND file IS NOT NULL").withColumn("node", symbol_node("symbol_id")).join(callers, "node", "left").fillna(0, ["caller_count"])
    order = Window.partitionBy("file").orderBy("symbol_id")
    s = s.withColumn("position", F.row_number().over(order)).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("position", "name", "kind", "line", "caller_count"))).alias("symbols"))
    s = s.select(F.col("file").alias("path"), F.transform("symbols", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["line"].alias("line"), x["caller_count"].alias("caller_count"), x["position"].alias("position"))).alias("symbols"))
    rows = g.files.select("path").join(into, "path", "left").join(out, "path", "left").join(s, "path", "left").fillna(0, ["importer_count", "import_count"])
    rows = rows.withColumn("symbols", F.coalesce("symbols", F.array().cast(f"array<{SYMBOL}>")))
    return rows.select(
        F.lit(name).alias("name"), F.lit(int(time.time()) if created_at is None else created_at).cast("long").alias("created_at"), F.lit(root).alias("project_root"), F.col("path").alias("file"),
        F.size("symbols").cast("long").alias("symbol_count"), "import_count", "importer_count", "symbols",
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change_type, file, name, changes): files and symbols added, removed or modified between two snapshots.

    Symbols are matched by name in files that both hold; the later of equal names counts."""
    f = before.select("file", F.lit(True).alias("a")).join(after.select("file", F.lit(True).alias("b")), "file", "full_outer")
    none = F.lit(None).cast("string")
    files = f.where("a IS NULL OR b IS NULL").select(F.when(F.col("a").isNull(), "added_file").otherwise("removed_file").alias("change_type"), "file", none.alias("name"), none.alias("changes"))
    both = f.where("a AND b").select("file")

    def symbols(snap: DataFrame, side: str) -> DataFrame:
        one = snap.join(both, "file", "left_semi").select("file", F.explode("symbols").alias("s"))
        return one.groupBy("file", F.col("s.name").alias("name")).agg(F.max_by("s", "s.position").alias(side))

    s = symbols(before, "x").join(symbols(after, "y"), ["file", "name"], "full_outer")
    said = lambda label, c: F.when(F.col(f"x.{c}") != F.col(f"y.{c}"), F.concat(F.lit(f"{label} "), F.col(f"x.{c}").cast("string"), F.lit(" → "), F.col(f"y.{c}").cast("string")))
    s = s.withColumn("changes", F.concat_ws("; ", said("kind", "kind"), said("line", "line"), said("callers", "caller_count")))
    s = s.withColumn("change_type", F.when(F.col("x").isNull(), "added_symbol").when(F.col("y").isNull(), "removed_symbol").when(F.col("changes") != "", "modified_symbol"))
    s = s.where("change_type IS NOT NULL").select("change_type", "file", "name", F.when(F.col("change_type") == "modified_symbol", F.col("changes")).alias("changes"))
    return files.unionByName(s).orderBy("change_type", "file", "name")


class SnapshotStore:
    """Snapshots as Parquet, one folder a name below `path`; the oldest go when there are more than KEEP."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> list[tuple[str, int]]:
        """(name, created_at), newest first."""
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return []
        rows = self.spark.read.option("recursiveFileLookup", "false").parquet(self.path).groupBy("snapshot").agg(F.min("created_at").alias("t")).collect() if len(fs.listStatus(p)) else []
        return sorted(((r.snapshot, r.t) for r in rows), key=lambda x: (-x[1], x[0]))

    def create(self, g: CodeGraph, name: str, created_at: int | None = None, root: str = "") -> None:
        if not NAME.fullmatch(name):
            raise ValueError("a snapshot's name has 1 to 64 letters, digits, dashes or underscores")
        have = [n for n in reversed(self.list()) if n[0] != name]
        for old, _ in have[: max(0, len(have) - KEEP + 1)]:
            self.delete(old)
        snapshot(g, name, created_at, root).write.mode("overwrite").parquet(f"{self.path}/snapshot={name}")

    def load(self, name: str) -> DataFrame:
        p, fs = self._fs(f"{self.path}/snapshot={name}")
        if not fs.exists(p):
            raise ValueError(f"no snapshot named {name}")
        return self.spark.read.parquet(f"{self.path}/snapshot={name}")

    def delete(self, name: str) -> None:
        p, fs = self._fs(f"{self.path}/snapshot={name}")
        if not fs.exists(p):
            raise ValueError(f"no snapshot named {name}")
        fs.delete(p, True)


def rotate(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """(name, created_at) of the snapshots that stay when one more is to come: the newest keep - 1."""
    order = Window.orderBy(F.desc("created_at"), "name")
    return snapshots.select("name", "created_at").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") < keep).drop("r")
