"""WARC round trips against digests computed in plain Python."""

import base64
import hashlib
from collections import defaultdict

import pytest

from tripgraph.llm import warc_chunks as W
from tripgraph.llm.queries import op2_warc_chunks

from . import brute


def expected(rows, least=0):
    of = defaultdict(list)
    for i, _, h in rows:
        of[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        head = max((x for x in of[p] if x is not None), default=None)
        again = len(p) >= least and i is not None and i != head
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", head if again else None, True))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (1, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nx"), (2, None, None), (3, "u v\n", ""), (4, "é", "\r\n\r\n"), (5, "u", "\r\n\r\n"),
    (None, "u", "\r\n\r\n"), (6, "x", "WARC/1.1\r\n" + "é" * 3000), (7, "x", "WARC/1.1\r\n" + "é" * 3000), (7, "x", "WARC/1.1\r\n" + "é" * 3000),
    (7, "x", "other"), (8, "y", "z" * 200_000),
]


@pytest.mark.parametrize("chunk", [7, 1000, W.CHUNK_BYTES])
def test_odd_rows(spark, chunk):
    df = spark.createDataFrame([(*r, "d") for r in ODD], "page_id bigint, url string, html string, digest string")
    assert result(W.archive_round_trip(df, chunk_bytes=chunk)) == expected(ODD)


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame(ODD, "page_id bigint, url string, html string")
    assert result(W.archive_round_trip(df, least_bytes=100)) == expected(ODD, 100)
    assert W.archive_round_trip(df.limit(0)).collect() == []


def test_files_split_anywhere(spark):
    pages = spark.read.parquet(f"{brute.SMALL}/pages.parquet").select("page_id", "url", "html")
    want = expected([tuple(r) for r in pages.collect()])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert result(W.archive_round_trip(pages.coalesce(2), chunk_bytes=5000)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_payloads_come_back(spark):
    path = W.archive_path(spark)
    df = spark.createDataFrame(ODD[:7], "page_id bigint, url string, html string")
    W.write_warc(df, path, chunk_bytes=11)
    got = defaultdict(dict)
    for r in W.read_warc(spark, path).where("record_type <> 'revisit' AND page_id IS NOT NULL").collect():
        got[r.page_id][r.chunk_no] = bytes(r.data)
    texts = {i: b"".join(parts[k] for k in sorted(parts)).decode() for i, parts in got.items()}
    assert texts == {1: ODD[0][2], 3: "", 5: "\r\n\r\n", 6: ODD[6][2]}


def test_archive_is_plain_warc(spark):
    path = W.archive_path(spark)
    W.write_warc(spark.createDataFrame([(1, "http://a/", "héllo"), (2, "http://b/", "")], "page_id bigint, url string, html string").coalesce(1), path)
    raw = "".join(r.value for r in spark.read.text(path, wholetext=True).collect()).encode()
    seen = []
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        seen.append((fields["WARC-Type"], fields["WARC-Target-URI"], raw[:size].decode()))
        assert raw[size : size + 4] == b"\r\n\r\n"
        raw = raw[size + 4 :]
    assert sorted(seen) == [("response", "http://a/", "héllo"), ("response", "http://b/", "")]


def test_missing_chunk_is_told(spark):
    rows = [("k", 0, 3, b"ab"), ("k", 2, 3, b"ef"), ("j", 0, 2, b"ab"), ("j", 1, 2, b"cd")]
    df = spark.createDataFrame(rows, "record_key string, chunk_no int, n_chunks int, data binary")
    got = {r.record_key: (r.bytes, r.complete) for r in W.digest_chunks(df).collect()}
    assert got == {"k": (4, False), "j": (4, True)}


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(op2_warc_chunks(spark, brute.SMALL)) == expected(pages)
