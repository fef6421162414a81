"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, materialize


HOT = 1_024


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left joined with right on key, where right has one row a key with n, how many of left's rows (rows in all) hold it.

    Keys of more than one HOTth of the rows (so there are fewer than HOT) meet by a broadcast of their rows of right;
    the other rows are dealt by key. No task gets more of one key than that share, whatever the keys are."""
    most = max(1, rows // HOT)
    hot = F.broadcast(right.where(F.col("n") > most).drop("n").limit(HOT))
    cold = left.join(F.broadcast(right.where(F.col("n") > most).select(key).limit(HOT)), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(right.where(F.col("n") <= most).drop("n"), key))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Each round hangs the neighbours of a node on its smallest neighbour; rounds grow with the logarithm of a
    component's diameter. A node of any degree is reduced by a partial aggregate, and its edges meet the result
    without being dealt by node (spread_join): no group of neighbours is ever gathered in one place. Self-loops and nulls are dropped; no edges give no rows."""
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    seen = _checksum(e)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = spread_join(both, low, "u", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "u", seen[0])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, e = e, materialize(small, "edges")
        drop_folder(spark, old._quarrylens_path)
        drop_folder(spark, large._quarrylens_path)
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return root.unionByName(root.select(F.col("component").alias("node"), "component").distinct())
