"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

language: documents whose language cannot be told go. near_duplicates: one document of each SimHash group stays.
substrings: words of windows that an earlier document holds are cut from the texts; a document left with none goes.
mix: rows are put into the order of the source schedule (file by file, row by row). encode: one row per document
with its sampled piece ids, and the file and row it was read from: sorted by these, rows stand in the mixed order.

Defined cases, in every stage: an empty table gives an empty table; other columns stay as they are, whatever their
names; texts of any length are taken whole. What a null id, a repeated row or a tie does, each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import langid, mixing, pieces, simhash, substring
from quarrylens.llm.common import materialize, prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose language cannot be told: null texts, texts without a letter, scores under 0.05.

    Ids play no part beyond the choice of the rows to learn from; repeated rows are judged alike, so all stay or go."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of similar texts: the least id, of equal ids the least hash of its text.

    Repeated rows are copies, one stays; different texts under one id are documents of their own; rows without an id stay."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the words of windows that a smaller id holds too; n_chars counts what is left, a text left empty goes.

    Rows without an id lose nothing and take nothing from others; rows of one id take nothing from each other."""
    return substring.remove_repeats(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs in the order of the schedule. Null is a source of its own; repeated rows and equal keys stand side by side."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, source, file and row (its place in the mixed order), ids, n_ids and decoded_sha256.

    A null text has no ids; a null id samples by a seed of its own, repeated rows by the same."""
    # the writer's random id goes, so that names sort by partition and are the same in every run
    file = F.regexp_replace("_metadata.file_name", r"^(part-\d+)-.*(-c\d+)\..*$", "$1$2")
    placed = docs.select("doc_id", "source", "text", file.alias("file"), F.col("_metadata.row_index").alias("row"))
    return pieces.tokenize(placed, ["doc_id", "source", "file", "row"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("encode", encode)]

# Fingerprints (XXH64), sampled segmentations and fitted filters have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
