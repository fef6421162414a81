"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names (one of our own only where it is unset in local mode)."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name where checkpoints go, for tables and states of streams."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder: executors need a shared one")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quarrylens-"))
    return f"{sc.getCheckpointDir()}/{name}"
