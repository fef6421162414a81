"""What the operators of this subpackage share: the shared folder, table access and byte-level text arrays."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and keep Arrow batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # rows hold whole documents: the default of 10,000 a batch would hold tens of megabytes on both sides
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset in local mode (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder: executors need a shared one")
        given = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrylens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrylens_path = path
    return out


def drop_folder(spark: SparkSession, path: str | None) -> None:
    """Remove a table that nothing reads any more."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names are compared as Spark does, without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows: what partition counts are sized by."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its offsets (one more than rows), without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        # a null's slot may hold bytes; squeeze it out
        parts = [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
    return raw, off


def _sizes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Where each row's bytes of a column begin, and where the last ends."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        return np.concatenate([[0], np.cumsum([len(v.as_buffer()) if v.is_valid else 0 for v in col])])
    _, off = byte_view(col)
    return off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join and cut record batches into slices of about `limit` bytes of one column; a longer row travels alone, and whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = int(_sizes(batch, column)[-1])
        if held and size + n > limit:
            yield from _slices(held, column, limit)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield from _slices(held, column, limit)


RELEASE_BYTES = 4 << 20  # of slices between two releases, as pages given back must be faulted in again
_used = [0]


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0  # another C library: nothing to give back


def release() -> None:
    """Give memory that the last slice used back to the system: a worker is kept for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _slices(held: list[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    off = _sizes(batch, column)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        _used[0] += int(off[end] - off[start])
        if _used[0] >= RELEASE_BYTES:
            _used[0] = 0
            release()
        start = end


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("n")
    if have is None or len(have) < n:
        size = max(n, 2 * HASH_BLOCK)
        for key, base in (("n", _MULT), ("i", _INV)):
            _POWERS[key] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
    return _POWERS["n"], _POWERS["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 lanes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


HASH_BLOCK = 256 << 10


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span raw[start:end]; equal bytes hash alike wherever they stand.

    Spans in order of their starts are taken block by block, so that the arrays behind the sums stay small."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) > 2 * HASH_BLOCK and (starts[1:] >= starts[:-1]).all():
        cuts = np.unique(np.searchsorted(starts, np.arange(0, int(starts[-1]) + HASH_BLOCK + 1, HASH_BLOCK)))
        return np.concatenate([_block_hashes(raw, starts[i:j], ends[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
    return _block_hashes(raw, starts, ends)


def span_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of raw, and the factors that take a span's start out of them; with hash_of: hashes of any spans."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def hash_of(between: np.ndarray, down: np.ndarray, length) -> np.ndarray:
    """Hashes of spans by the difference of their sums, the factors of their starts and their lengths."""
    return mix64(between * down ^ np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _block_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = int(starts.min())
    sums, down = span_sums(raw[low : int(ends.max())])
    return hash_of(sums[ends - low] - sums[starts - low], down[starts - low], ends - starts)


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of several texts: joined by one space, their starts and ends in that, and the words of each text."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    joined = b" ".join([w for ws in split for w in ws])
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], gaps + 1]) if len(joined) else np.zeros(0, np.int64)
    ends = np.concatenate([gaps, [len(joined)]]) if len(joined) else np.zeros(0, np.int64)
    return joined, starts.astype(np.int64), ends.astype(np.int64), counts
