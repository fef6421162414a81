import base64
import gzip
import hashlib

import duckdb
from pyspark.sql import functions as F

from quarrylens.llm import warc
from quarrylens.llm.common import new_folder


def rows():
    out = [(i, f"http://h/{i}", f"<p>{i % 7} ü</p>" * (1 + i % 3)) for i in range(60)]
    return [*out, (100, None, None), (101, "http://a b/\r\nX: y", ""), (102, "u", "WARC/1.1\r\n\r\n" * 50), (103, "u", "x" * 3_000_000), (5, "other", out[5][2]), (None, "n", out[9][2]), (None, "m", "alone")]


def test_round_trip_and_revisits(spark):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS first").repartition(4)
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in data:
        b, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted([tuple(r) for r in warc.op9(df).collect()], key=str) == sorted(want, key=str)
    assert warc.op9(df.limit(0)).count() == 0
    sql = duckdb.connect()
    clean = [r for r in data if r[0] is not None][:-1]
    sql.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    sql.executemany("INSERT INTO pages VALUES (?, ?, ?)", clean)
    got = warc.op9(spark.createDataFrame(clean, "page_id long, url string, html string")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r) for r in got.collect()]) == sorted(sql.execute(warc.ORACLE).fetchall())


def test_selected_records_by_index(spark, monkeypatch):
    data = [(i, f"http://h/{i}", f"page {i}".encode() * 50) for i in range(200)]
    df = spark.createDataFrame(data, "page_id long, url string, payload binary").coalesce(2)
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(df, folder)
    some = index.where(F.col("page_id") % 7 == 3)
    for gap in (0, 1 << 20):
        monkeypatch.setattr(warc, "GAP", gap)
        got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, some, folder).collect()}
        assert got == {i: p for i, _, p in data if i % 7 == 3}
    path = folder.removeprefix("file://")
    row = index.where("page_id = 10").first()
    with open(f"{path}/{row.file}", "rb") as f:
        whole = gzip.decompress(f.read())
    assert whole.count(b"WARC-Type: response") == index.where(F.col("file") == row.file).count()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
