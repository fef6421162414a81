"""Text search over symbol names: trigrams, BM25, rank fusion and the tiers of one search box.

Symbols are (symbol_name, file_path, line, ...). Scores are doubles; ties go by path, then line, then name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_identifier, trigrams
from ..schema import CodeGraph
from .lookup import find, placed

K1, B, AVERAGE = 1.2, 0.75, 8.0
RRF_K = 60
MIN_TRIGRAM = 0.3


def documents(g: CodeGraph) -> DataFrame:
    return placed(g).where("file_path IS NOT NULL").select(F.col("name").alias("symbol_name"), "kind", "file_path", "line", "line_end", "col", "is_exported", "is_default", "visibility", "decorators")


def top(df: DataFrame, score: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(score), "file_path", "line", "symbol_name").limit(limit)


def trigram_search(docs: DataFrame, query: str, limit: int = 20, least: float = MIN_TRIGRAM) -> DataFrame:
    """Names whose trigrams overlap the query's by a Jaccard share of least or more; distinct names are scored once."""
    q = trigrams(F.lit(query))
    names = docs.select("symbol_name").distinct().withColumn("g", trigrams(F.col("symbol_name")))
    hit = F.size(F.array_intersect("g", q))
    union = F.size("g") + F.size(q) - hit
    scored = names.withColumn("score", F.when(union > 0, hit / union).otherwise(0.0)).where(F.col("score") >= least).drop("g")
    return top(docs.join(scored, "symbol_name"), "score", limit)


def trigram_pairs(names: DataFrame, queries: DataFrame, least: float = MIN_TRIGRAM) -> DataFrame:
    """(query, symbol_name, score) for many queries at once, by an inverted index of trigrams."""
    n = names.select("symbol_name").distinct().withColumn("g", trigrams(F.col("symbol_name")))
    q = queries.select("query").distinct().withColumn("h", trigrams(F.col("query")))
    common = n.select("symbol_name", F.size("g").alias("a"), F.explode("g").alias("t")).join(q.select("query", F.size("h").alias("b"), F.explode("h").alias("t")), "t")
    both = common.groupBy("query", "symbol_name", "a", "b").agg(F.count("*").alias("n"))
    return both.select("query", "symbol_name", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("score")).where(F.col("score") >= least)


def words(c: F.Column) -> F.Column:
    """Lower-case words of letters and digits; no stemming."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame) -> DataFrame:
    """(symbol_name, term, tf, length) of the distinct names' identifier texts, with their number of symbols n."""
    names = docs.groupBy("symbol_name").agg(F.count("*").alias("n")).withColumn("w", words(split_identifier(F.col("symbol_name"))))
    return names.select("symbol_name", "n", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("symbol_name", "n", "length", "term").agg(F.count("*").alias("tf"))


def bm25_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Names by BM25 with idf ln(1 + (N - n + .5) / (n + .5)) over symbols and a fixed average length."""
    p = postings(docs)
    terms = docs.sparkSession.range(1).select(F.explode(F.array_distinct(words(F.lit(query)))).alias("term"))
    own = p.join(F.broadcast(terms), "term")  # as many rows as the query has words
    df = own.groupBy("term").agg(F.sum("n").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    own = own.join(df, "term").join(total, F.lit(True))
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / AVERAGE))
    scored = own.withColumn("part", part).groupBy("symbol_name").agg(F.round(F.sum("part"), 12).alias("score"))  # ties do not hang on the order of the sum
    return top(docs.join(scored, "symbol_name"), "score", limit)


def ranked(df: DataFrame, score: str = "score") -> DataFrame:
    """df with its place in score order; lists are short (a search's limit)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "file_path", "line", "symbol_name")))


def fuse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; rows of one name and line are one, the first list's stands."""
    both = a.select(F.lit(0).alias("source"), *[c for c in a.columns if c not in ("source", "score")]).unionByName(b.select(F.lit(1).alias("source"), *[c for c in b.columns if c not in ("source", "score")]))
    key = F.concat_ws(":", "symbol_name", F.col("line").cast("string"))
    first = Window.partitionBy("key").orderBy("source", "rank")
    scored = both.withColumn("key", key).withColumn("score", F.sum(1.0 / (RRF_K + F.col("rank"))).over(Window.partitionBy("key"))).withColumn("r", F.row_number().over(first)).where("r = 1")
    return scored.drop("key", "r", "source", "rank").orderBy(F.desc("score"), "file_path", "line")


FOUND = ["symbol_name", "kind", "file_path", "line", "line_end", "is_exported"]


def fused(g: CodeGraph, query: str, limit: int = 20) -> DataFrame:
    """Trigram and BM25 hits as one list, rows of one name and line as one, also where one of the two finds nothing."""
    docs = documents(g)
    return fuse(ranked(trigram_search(docs, query, limit)), ranked(bm25_search(docs, query, limit))).limit(limit).select(FOUND)


def search(g: CodeGraph, query: str, limit: int = 20) -> DataFrame:
    """Matches of the query as a pattern, case aside; without any, trigram and BM25 hits, fused if both have some."""
    limit = min(limit, 500)
    try:
        exact = find(g, query, ignore_case=True).limit(limit)
        if not exact.isEmpty():
            return exact.select(FOUND)
    except ValueError:
        pass  # not a pattern: the tiers below still apply
    docs = documents(g)
    a, b = trigram_search(docs, query, limit), bm25_search(docs, query, limit)
    if a.isEmpty():
        return b.select(FOUND)
    if b.isEmpty():
        return a.select(FOUND)
    return fused(g, query, limit)
