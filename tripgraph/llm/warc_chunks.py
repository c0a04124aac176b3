"""WARC archives as a chunked record table.

A record's payload is a run of chunk rows (record_key, chunk_no, data) of
bounded size; a payload of several chunks is written as a segmented record (the
format's continuation records), so neither writing, reading nor digesting ever
holds such a payload as one value. Digests are taken over chunk rows: one chunk
natively, several by feeding them in order to one running SHA-1 state.

Archives are written and read by Spark's text source, so they may lie in any
store that Spark reaches. Each archive has a random boundary, repeated in every
record's first header line, which the reader uses as its record separator, as a
MIME reader does: no payload can hold it by accident, and files stay splittable.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.broadcast import checked_broadcast
from ..session import scratch_path
from .common import written

CHUNK_BYTES = 65_536
# Rows of the revisit table that may be broadcast to the writer; beyond it the join shuffles the payloads.
BROADCAST_REVISITS = 500_000
NL = "\r\n"
# Fixed value: the two alphabets that base32 digits are written in.
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column (160 bits: 32 digits)."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def chunk_rows(records: DataFrame, payload: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of ``payload`` (binary), which is replaced by
    chunk_no, n_chunks and data. An empty payload is one empty chunk."""
    n = F.greatest(F.ceil(F.length(payload) / chunk_bytes), F.lit(1)).cast("int")
    rows = records.withColumn("n_chunks", n).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    return rows.withColumn("data", F.expr(f"substring({payload}, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")).drop(payload)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length of each record from its chunks, which come in order."""
    import base64

    key, state, size, last = None, None, 0, None
    done: list[tuple[str, int, str, bool]] = []

    def close() -> None:
        if key is not None:
            done.append((key, size, base64.b32encode(state.digest()).decode(), last[0] + 1 == last[1]))

    for b in batches:
        keys, no, of = (b.column(i).to_pylist() for i in range(3))
        for i, k in enumerate(keys):
            if k != key:
                close()
                key, state, size, last = k, hashlib.sha1(), 0, (-1, of[i])
            part = b.column(3)[i].as_buffer()
            state.update(part)
            size += part.size
            last = (last[0] + 1 if no[i] == last[0] + 1 else -(10**9), of[i])
        if done:
            yield _digest_batch(done)
            done = []
    close()
    if done:
        yield _digest_batch(done)


def _digest_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                                      ["record_key", "bytes", "digest", "complete"])


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """(record_key, bytes, digest, complete) of each record of a chunk table
    (record_key, chunk_no, n_chunks, data). Only records of several chunks are
    shuffled; complete is false if a chunk is missing or repeated."""
    one = chunks.where("n_chunks = 1").select(
        "record_key", F.length("data").cast("bigint").alias("bytes"), sha1_base32(F.col("data")).alias("digest"), F.lit(True).alias("complete"))
    many = chunks.where("n_chunks > 1").select("record_key", "chunk_no", "n_chunks", "data")
    many = many.repartition("record_key").sortWithinPartitions("record_key", "chunk_no")
    return one.unionByName(many.mapInArrow(_running, "record_key string, bytes bigint, digest string, complete boolean"))


def revisits(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, bytes, head): rows whose payload another page holds,
    of at least ``least_bytes``; head is the largest page_id with it."""
    heads = digests.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("head"))
    return digests.join(heads, ["digest", "bytes"]).where("page_id < head").select("page_id", "digest", "bytes", "head").distinct()


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z",
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one WARC record per row of ``pages`` into the folder ``path``,
    whose last part ends in the archive's boundary (see ``archive_path``)."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    uri = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\s\p{Cntrl}]", "%20")
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    src = src.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("bytes", F.length("payload").cast("bigint"))
    again = checked_broadcast(written(revisits(src.select("page_id", "digest", "bytes"), least_bytes), "revisits"), BROADCAST_REVISITS)
    rows = src.join(again, ["page_id", "digest", "bytes"], "left")
    rows = rows.withColumn("payload", F.when(F.col("head").isNull(), F.col("payload")).otherwise(F.lit(b""))).withColumn(
        "record", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"),
                           F.monotonically_increasing_id().cast("string")))
    chunks = chunk_rows(rows, "payload", chunk_bytes)
    first, many = F.col("chunk_no") == 0, F.col("n_chunks") > 1

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit(NL))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    def urn(value: Column) -> Column:
        return F.concat(F.lit("<"), value, F.lit(">"))

    revisit = F.col("head").isNotNull()
    header = F.concat(
        F.lit(f"WARC/1.1{NL}WARC-X-Boundary: {_boundary(path)}{NL}"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", urn(F.concat("record", F.lit("/"), F.col("chunk_no").cast("string")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), many),
        line("WARC-X-Segments", F.col("n_chunks").cast("string"), many),
        line("WARC-Segment-Origin-ID", urn(F.concat("record", F.lit("/0"))), ~first),
        line("WARC-Segment-Total-Length", F.col("bytes").cast("string"), many & (F.col("chunk_no") == F.col("n_chunks") - 1)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-X-Payload-Length", F.col("bytes").cast("string")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Refers-To", urn(F.concat(F.lit("urn:page:"), F.col("head").cast("string"))), revisit),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.length("data").cast("string")),
    )
    chunks.select(F.concat(header, F.lit(NL), F.col("data").cast("string"), F.lit(NL)).alias("value")).write.option("lineSep", NL).text(path)


def archive_path(spark: SparkSession, name: str = "pages") -> str:
    """A new folder for one archive in the shared folder."""
    return f"{scratch_path(spark, name)}-{uuid.uuid4().hex}.warc"


def _boundary(path: str) -> str:
    found = re.search(r"([0-9a-f]{32})\.warc/*$", path)
    if not found:
        raise ValueError(f"{path} does not end in an archive's boundary; see archive_path()")
    return found[1]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive: (record_key, page_id, chunk_no, n_chunks,
    record_type, refers_to, declared_digest, declared_bytes, data)."""
    mark = f"WARC/1.1{NL}WARC-X-Boundary: {_boundary(path)}{NL}"
    # Every record but a file's first loses the separator; the content length says what of its end is payload.
    rows = spark.read.option("lineSep", f"{NL}{NL}{mark}").text(path).where(F.col("value") != "")
    head = F.concat(F.substring_index("value", NL + NL, 1), F.lit(NL))
    rows = rows.select("value", head.alias("head"))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
        return F.when(got != "", got)

    start = F.length(F.col("head").cast("binary")) + F.lit(len(NL) + 1)
    rows = rows.select(
        field("WARC-Record-ID").alias("id"), field("WARC-Type").alias("record_type"), field("WARC-Refers-To").alias("to"),
        F.coalesce(field("WARC-Segment-Number").cast("int") - 1, F.lit(0)).alias("chunk_no"),
        F.coalesce(field("WARC-X-Segments").cast("int"), F.lit(1)).alias("n_chunks"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("declared_digest"),
        field("WARC-X-Payload-Length").cast("bigint").alias("declared_bytes"),
        F.substring(F.col("value").cast("binary"), start, field("Content-Length").cast("int")).alias("data"))
    key = F.regexp_extract("id", r"^<(.*)/\d+>$", 1)
    return rows.select(
        key.alias("record_key"), F.regexp_extract("id", r"^<urn:page:(-?\d+|null):", 1).try_cast("bigint").alias("page_id"),
        "chunk_no", "n_chunks", "record_type", F.regexp_extract("to", r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint").alias("refers_to"),
        "declared_digest", "declared_bytes", "data")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive and read it back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to, verified)
    for every row, verified if the digest of the chunks read is the declared one.

    Of equal payloads the one with the largest page_id is a response and the
    others revisit it; payloads under ``least_bytes`` are all responses. A null
    html is an empty payload. A row with a null page_id is a response that
    nothing refers to. Rows that repeat a response's id and payload are
    responses too. Null urls are written empty. Other columns are not read. An
    empty table gives no rows.
    """
    spark = pages.sparkSession
    path = archive_path(spark)
    write_warc(pages, path, least_bytes, chunk_bytes)
    chunks = read_warc(spark, path)
    about = chunks.where("chunk_no = 0").select("record_key", "page_id", "record_type", "refers_to", "declared_digest", "declared_bytes", "n_chunks", "data")
    seen = F.when(F.col("record_type") == "revisit", F.col("declared_digest")).otherwise(sha1_base32(F.col("data")))
    bytes_ = F.when(F.col("record_type") == "revisit", F.col("declared_bytes")).otherwise(F.length("data").cast("bigint"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    one = about.where("n_chunks = 1").select(
        "page_id", bytes_.alias("payload_bytes"), seen.alias("payload_digest"), "record_type", "refers_to",
        ((seen == F.col("declared_digest")) & (bytes_ == F.col("declared_bytes"))).alias("verified"))
    many = digest_chunks(chunks.where("n_chunks > 1")).join(about.where("n_chunks > 1").drop("data"), "record_key").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to",
        (F.col("complete") & (F.col("digest") == F.col("declared_digest")) & (F.col("bytes") == F.col("declared_bytes"))).alias("verified"))
    return one.unionByName(many).select(*cols)
