"""The queries of this subpackage, by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import covertree, htmltext, langid, mixing, pieces, simhash, substring, topk, toxicity, warc
from .common import prepare, table


def _of(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(table(spark, sf_dir, name))

    return run


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": _of("documents", mixing.op1),
        "op2_simhash": _of("documents", simhash.op2),
        "op7_topk": _of("embeddings", topk.op7),
        "op8_covertree": _of("embeddings", covertree.op8),
        "op9_warc": _of("pages", warc.op9),
        "op10_langid": _of("documents", langid.op10),
        "pipeline": corpus_pipeline.run,
        "op3_pieces": _of("documents", pieces.op3),
        "op4_htmltext": _of("pages", htmltext.op4),
        "op5_substring": _of("documents", substring.op5),
        "op6_toxicity": _op6,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring": substring.ORACLE, "op7_topk": topk.ORACLE, "op8_covertree": covertree.ORACLE, "op9_warc": warc.ORACLE}
