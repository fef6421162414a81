"""Retrieval for questions: citations by structure and by meaning, merged, with snippets, vectors and sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_kind, search_pattern
from ..schema import CodeGraph
from ..session import prepare, spread
from .lookup import find, placed

CITATIONS, SNIPPETS, SNIPPET_LINES, SESSIONS, BATCH = 5, 3, 40, 100, 256


def classify(query: str, spark) -> str:
    return spark.range(1).select(query_kind(F.lit(query)).alias("k")).first().k


def pattern_of(query: str, spark) -> str:
    return spark.range(1).select(search_pattern(F.lit(query)).alias("p")).first().p


def _numbered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("index", F.row_number().over(Window.orderBy(*order)))


def structural(g: CodeGraph, query: str) -> DataFrame:
    """Up to five (index, file_path, line_start, symbol_name) whose names match the question's words."""
    hits = find(g, pattern_of(query, g.spark), ignore_case=True).limit(CITATIONS)
    return _numbered(hits.select("file_path", F.col("line").alias("line_start"), "symbol_name"), F.split("file_path", "/"), "line_start", "symbol_name").select("index", "file_path", "line_start", "symbol_name")


def embedding_text(name: str = "symbol_name", path: str = "file_path", line: str = "line_start") -> F.Column:
    return F.concat(F.col(name), F.lit(" in "), F.col(path), F.lit(":"), F.col(line).cast("string"))


_HASHES: dict[int, int] = {}  # of trigrams met by this process
_MOST_HASHES = 1 << 20


def _trigram_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of trigrams, each three characters of 21 bits."""
    if len(_HASHES) > _MOST_HASHES:
        _HASHES.clear()
    out = np.empty(len(codes), np.uint64)
    for i, c in enumerate(codes.tolist()):
        if (h := _HASHES.get(c)) is None:
            text = chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF)
            h = _HASHES[c] = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
        out[i] = h
    return out


def _trigram_vectors(texts: list[str], dimensions: int) -> np.ndarray:
    """Rows of signed counts of the texts' hashed trigrams, scaled to one; a whole batch is counted in arrays."""
    padded = [f"  {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    row = np.repeat(np.arange(len(padded)), size)
    inside = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    codes, at = np.unique(chars[inside] << 42 | chars[inside + 1] << 21 | chars[inside + 2], return_inverse=True)
    h = _trigram_hashes(codes)
    place, sign = (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(row[inside] * dimensions + place[at], sign[at], len(padded) * dimensions).reshape(len(padded), dimensions).astype(np.float32)
    n = np.sqrt((v * v).sum(1, dtype=np.float64)).astype(np.float32)  # counts: sums of squares are exact
    return v / np.where(n > 0, n, np.float32(1))[:, None]


def hashing_embedder(dimensions: int = 384) -> Callable[[pd.Series], pd.Series]:
    """A deterministic embedder for use without a model: signed hashes of a text's character trigrams, scaled to one."""

    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(_trigram_vectors([t or "" for t in texts], dimensions).tolist())

    embed.matrix = lambda texts: _trigram_vectors([t or "" for t in texts], dimensions)  # the same, as an array
    return embed


def embed_symbols(symbols: DataFrame, embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """symbols (symbol_name, file_path, line_start, kind) with vec; the embedder sees batches of 256 texts."""
    from collections.abc import Iterator

    f = embedder or hashing_embedder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.concat([f(texts.iloc[i : i + BATCH]) for i in range(0, len(texts), BATCH)]) if len(texts) else pd.Series([], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    prepare(symbols.sparkSession)
    return symbols.withColumn("vec", F.pandas_udf(run, "array<float>")(embedding_text()))


def symbol_texts(g: CodeGraph) -> DataFrame:
    """(key, file_path, symbol_name, line_start, kind) of all symbols with a file, dealt out anew for the embedder."""
    return spread(placed(g).where("file_path IS NOT NULL").select(F.col("symbol_id").alias("key"), "file_path", F.col("name").alias("symbol_name"), F.col("line").alias("line_start"), "kind"), "key")


def symbol_vectors(g: CodeGraph, embedder=None) -> DataFrame:
    return embed_symbols(symbol_texts(g), embedder)


def cosine_distance(a: F.Column, b: F.Column) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "key", vec: str = "vec") -> DataFrame:
    """The k rows nearest to a vector by cosine distance, with distance; ties by key. Exact: a scan with a bounded sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size(vec) == len(query)).withColumn("distance", cosine_distance(F.col(vec), q)).orderBy("distance", key).limit(k)


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """cosine_distance of rows to a vector, summed in the same order and so to the last bit."""
    dot = lambda a, b: np.add.accumulate(a * b, axis=-1)[..., -1]
    norm = np.sqrt(dot(vectors, vectors) * dot(query, query))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm == 0, 1.0, 1.0 - dot(vectors, query) / norm)


def nearest_symbols(symbols: DataFrame, query: list[float], k: int, embedder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """The rows of nearest(embed_symbols(symbols, embedder), query, k) without vec: each task keeps its k best, so that no vector leaves it."""
    prepare(symbols.sparkSession)
    f = embedder or hashing_embedder()
    columns = ["key", "file_path", "symbol_name", "line_start", "kind"]

    def matrix(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts whose vectors are as long as the query, and these vectors."""
        if hasattr(f, "matrix"):
            m = f.matrix(texts)
            return np.arange(len(texts)) if m.shape[1] == len(query) else np.zeros(0, np.int64), m
        found = list(f(texts))
        fit = [i for i, v in enumerate(found) if v is not None and len(v) == len(query)]
        return np.array(fit, np.int64), np.array([found[i] for i in fit], np.float32).reshape(len(fit), len(query))

    def run(frames):
        q = np.asarray(query, float)
        best = None
        for frame in frames:
            for i in range(0, len(frame), BATCH):
                part = frame.iloc[i : i + BATCH]
                at, m = matrix(part["text"])
                if not len(at):
                    continue
                d = _distances(m.astype(float), q)
                if best is not None and len(best) == k:
                    low = ~(d > best["distance"].iloc[-1])
                    at, d = at[low], d[low]
                if len(at):
                    own = part.iloc[at][columns].assign(distance=d)
                    best = (own if best is None else pd.concat([best, own])).sort_values(["distance", "key"]).head(k)
        if best is not None:
            yield best

    kinds = ", ".join(f"`{c}` {symbols.schema[c].dataType.simpleString()}" for c in columns)
    return symbols.select(*columns, embedding_text().alias("text")).mapInPandas(run, f"{kinds}, distance double").orderBy("distance", "key").limit(k)


def nearest_approx(vectors: DataFrame, query: list[float], k: int, key: str = "key", vec: str = "vec", tables: int = 6, width: float = 0.7, seed: int = 1) -> DataFrame:
    """Approximate nearest rows by random projections of unit vectors; candidates are re-ranked by exact distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.withColumn("__raw", array_to_vector(F.col(vec)))
    unit = Normalizer(inputCol="__raw", outputCol="__unit").transform(rows)
    model = BucketedRandomProjectionLSH(inputCol="__unit", outputCol="__hash", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    n = float(np.linalg.norm(query)) or 1.0
    found = model.approxNearestNeighbors(unit, Vectors.dense([x / n for x in query]), 4 * k).drop("__raw", "__unit", "__hash", "distCol")
    return nearest(found, query, k, key, vec)


def conceptual(vectors: DataFrame, query: str, embedder=None) -> DataFrame:
    """Up to five citations whose texts lie nearest to the question; vectors without vec are embedded on the way."""
    f = embedder or hashing_embedder()
    v = list(f(pd.Series([query])).iloc[0])
    near = nearest(vectors, v, CITATIONS) if "vec" in vectors.columns else nearest_symbols(vectors, v, CITATIONS, f)
    return _numbered(near, "distance", "key").select("index", "file_path", "line_start", "symbol_name")


def merge(first: DataFrame, second: DataFrame, limit: int = CITATIONS) -> DataFrame:
    """Citations of both lists, the first list's before, one a symbol of a file, numbered anew."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    own = Window.partitionBy("file_path", "symbol_name").orderBy("list", "index")
    one = both.withColumn("r", F.row_number().over(own)).where("r = 1").orderBy("list", "index").limit(limit)
    return one.withColumn("index", F.row_number().over(Window.orderBy("list", "index"))).select("index", "file_path", "line_start", "symbol_name")


def snippets(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations with snippet: up to 40 lines from line_start, for the first three; sources are (path, content)."""
    lines = F.split("content", "\n")
    own = citations.join(sources.withColumnRenamed("path", "file_path"), "file_path", "left")
    cut = F.array_join(F.slice(lines, F.greatest(F.col("line_start"), F.lit(1)), SNIPPET_LINES), "\n")
    return own.withColumn("snippet", F.when((F.col("index") <= SNIPPETS) & F.col("content").isNotNull(), cut)).drop("content").orderBy("index")


def retrieve(g: CodeGraph, vectors: DataFrame | None, sources: DataFrame, query: str, kind: str | None = None, embedder=None) -> tuple[DataFrame, DataFrame]:
    """(citations with snippets, one row of context_text and tools_used) for a question of any kind."""
    kind = kind or classify(query, g.spark)
    if kind == "Structural" or vectors is None:
        found, tools = structural(g, query), ["find_symbol"]
    elif kind == "Conceptual":
        found, tools = conceptual(vectors, query, embedder), ["vector_search"]
    else:
        found, tools = merge(structural(g, query), conceptual(vectors, query, embedder)), ["find_symbol", "vector_search"]
    cited = snippets(found, sources)
    head = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("symbol_name"), F.lit(" — "), F.col("file_path"), F.lit(":"), F.col("line_start").cast("string"))
    text = F.concat_ws("\n", head, F.col("snippet"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", text.alias("t")))), lambda x: x["t"]), "\n\n")
    return cited, cited.agg(F.coalesce(joined, F.lit("")).alias("context_text")).withColumn("tools_used", F.array(*map(F.lit, tools)))


# The instructions that a language model gets.
INSTRUCTIONS = (
    "Answer only from the given code context; say so if it does not hold the answer.",
    "Mark every symbol, file or snippet that you use with its number, like [1].",
    "Be brief; write for developers; use markdown for code.",
)


def system_prompt(project_stats: str) -> str:
    return "You answer questions about one software project from excerpts of its code.\n\nProject overview:\n" + project_stats + "\n\n" + "\n".join(f"- {x}" for x in INSTRUCTIONS)


def user_prompt(query: str, context_text: str) -> str:
    return f"Codebase context:\n{context_text}\n\nQuestion: {query}" if context_text else query


def ask(g: CodeGraph, vectors, sources, query: str, history: list[tuple[str, str]], model: Callable[[list[tuple[str, str]]], str], stats: str = "") -> dict:
    """One turn: retrieve, build the messages, call the given model; the answer with its citations."""
    cited, text = retrieve(g, vectors, sources, query)
    row = text.first()
    messages = [("system", system_prompt(stats)), *history, ("user", user_prompt(query, row.context_text))]
    return {"answer": model(messages), "citations": [r.asDict() for r in cited.collect()], "tools_used": list(row.tools_used), "messages": messages}


def sessions(turns: DataFrame, keep: int = SESSIONS) -> DataFrame:
    """(conv_id, last_used, history): the most recently used sessions with their messages in order.

    turns are (conv_id, turn, role, text, used_at); ranks are taken over one row a session."""
    last = turns.groupBy("conv_id").agg(F.max("used_at").alias("last_used")).orderBy(F.desc("last_used"), "conv_id").limit(keep)
    own = turns.join(last, "conv_id").groupBy("conv_id", "last_used").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    return own.orderBy(F.desc("last_used"), "conv_id")


def re_embed(vectors: DataFrame, changed: DataFrame, embedder=None) -> DataFrame:
    """vectors with those of changed files replaced: changed symbols are (key, file_path, symbol_name, line_start, kind); a file's stale rows go."""
    files = changed.select("file_path").distinct()
    return vectors.join(files, "file_path", "left_anti").unionByName(embed_symbols(changed, embedder).select(vectors.columns))
