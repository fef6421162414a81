"""WARC archives in the shared folder, written with an index and read back by coalesced byte ranges.

Each task writes the records of its rows as gzip members of one archive file (named by task attempt, so a repeated
task never touches another's file) and returns an index row per record: file, offset, length, URL and payload
digest. The index is a table of its own and comes first: readers choose index rows, deal them out by file and
stretch of STRETCH bytes, sort them by offset and fetch neighbours (GAP bytes apart or less) in one read.

Records with equal payloads: the one with the smallest page id is a response, the others are revisits that refer to
it. Equality is by SHA-256 and length; sizes of groups do not matter, as ids are reduced by a partial aggregate.

Defined cases: a null payload is empty; rows repeated with the same id and payload are all responses if theirs is
the smallest id; a row without an id is a revisit if its payload has a row with one, else a response; line breaks
in a URL are escaped, a null URL stays null; an empty table writes no archive and gives no rows."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, pieces, prepare

SLICE_BYTES = 4 << 20
STRETCH = 32 << 20
GAP = 64 << 10
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, revisit: bool) -> bytes:
    """One record, uncompressed: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(chr(c) for c in range(33, 127))))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """Header fields, by lower-case name, with `block`, `http` (its fields) and `payload` of a record's bytes."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return out | {"payload": payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with first: the smallest page id of its payload, null where it stands alone or is shorter than least_bytes."""
    keyed = pages.withColumn("k", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    groups = keyed.where(F.col("n") >= least_bytes).groupBy("k", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL")
    groups = materialize(groups.drop("rows"), "payloads")
    return keyed.join(groups, ["k", "n"], "left").drop("k", "n")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, payload binary) below folder; the index, as a table."""
    spark = pages.sparkSession
    prepare(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def run(batches):
        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        file, out, offset = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz", None, 0
        try:
            for part in pieces(batches, "payload", SLICE_BYTES):
                rows = []
                for p, url, payload, first in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{file}", compression=None)
                    digest = sha1_base32(payload)
                    revisit = first is not None and p != first
                    press = zlib.compressobj(6, wbits=31)
                    member = press.compress(record(p, url, payload, first, digest, revisit)) + press.flush()
                    out.write(member)
                    rows.append((p, url, file, offset, len(member), digest, len(payload), "revisit" if revisit else "response"))
                    offset += len(member)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    marked = with_first(pages, least_bytes).select("page_id", "url", "payload", "first")
    return materialize(marked.mapInArrow(run, INDEX), "warc-index")


def read_archives(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit)."""
    prepare(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def runs(batches):
        """Index rows in order, cut where a read must end: (file, offset, bytes, rows)."""
        file, start, end, own = None, 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                f, offset, length = row[:3]
                if own and (f != file or offset > end + GAP or offset + length - start > READ_BYTES):
                    yield file, start, end, own
                    own = []
                if not own:
                    file, start, end = f, offset, offset
                own.append(row)
                end = max(end, offset + length)
        if own:
            yield file, start, end, own

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        opened, source = None, None
        for file, start, end, own in runs(batches):
            if file != opened:
                if source is not None:
                    source.close()
                opened, source = file, fs.open_input_file(f"{base}/{file}")
            data = source.read_at(end - start, start)
            out = []
            for _, offset, length, page_id, url, digest in own:
                r = read_record(zlib.decompress(data[offset - start : offset - start + length], wbits=31))
                revisit = r["warc-type"] == "revisit"
                if r["warc-payload-digest"] != f"sha1:{digest}" or not revisit and sha1_base32(r["payload"]) != digest:
                    raise ValueError(f"{file} at {offset}: the payload is not the one of the index")
                refers = int(r["warc-refers-to"][len("<urn:page:") : -1]) if revisit else None
                out.append((page_id, url, r["warc-type"], refers, r["warc-payload-digest"][5:], int(r["http"]["content-length"]), None if revisit else r["payload"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if source is not None:
            source.close()

    chosen = index.select("file", "offset", "length", "page_id", "url", "payload_digest").withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    dealt = chosen.repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op9(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    index = write_archives(rows, folder)
    return read_archives(spark, index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of a SHA-1: four groups of ten hex digits, eight letters each
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(s, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1) FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT p.page_id, p.h, f.first, sha1(p.h) AS s FROM p JOIN f USING (h))
"""
