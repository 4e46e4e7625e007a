"""Operator 10, WARC transaction assembly.

write_warc() turns captures into WARC/1.1 files of three records each: a request, a response (or a revisit that
refers to the first response of equal payload) and a metadata record; response and metadata name the request in
WARC-Concurrent-To. read_warc() parses such files, and assemble() joins the three through those identifiers into
one nested row per capture. Files are written by Spark's text writer with the record end as line separator, and
read with the binaryFile source, so any file system that Spark knows will do; a file holds a bounded number of
captures.

Cases: null html is an empty payload; null url is an empty URI; equal payloads have the smallest page_id as response
(null page_ids come last; rows that repeat that page_id with the same payload are responses too, and a revisit
refers to the page_id they share); an empty table gives no captures; extra columns are ignored. Each input row is
one capture with identifiers of its own, so repeated rows stay apart.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, workspace

NL, END = "\r\n", "\r\n\r\n"
#: RFC 4648 alphabet, beside the digits that conv() writes in base 32.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_digest string, block_digest_ok boolean, payload_bytes long, headers map<string,string>, payload binary"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: each 5 hexadecimal digits are 4 digits in base 32."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _uuid(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: Column | str, fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(NL, *head), F.lit(END), block)


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, per_file: int = 2000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every row (page_id, url, html) as request, response or revisit, and metadata records under folder."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", sha1_base32(F.encode("html", "utf-8")))
    shared = base.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit_bytes)
    firsts = shared.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id")
    rows = base.join(firsts, "digest", "left").withColumn("cap", F.expr("uuid()"))
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    request_id = F.concat(F.lit("<urn:uuid:"), F.col("cap"), F.lit(">"))
    known = lambda page: _uuid(F.concat_ws("/", F.lit("response"), page.cast("string"), F.col("digest")))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    about = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("X-Page-Id", number)]
    http = F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{END}")
    request = _record("request", [("WARC-Record-ID", request_id), *about, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{NL}Host: "), host, F.lit(END)))
    common = [("WARC-Concurrent-To", request_id), *about, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", [("WARC-Record-ID", known(F.col("page_id"))), *common], F.concat(http, F.col("html")))
    again = _record("revisit", [("WARC-Record-ID", _uuid(F.concat(F.lit("revisit/"), F.col("cap")))), ("WARC-Refers-To", known(F.col("first_id"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), *common], http)
    meta = _record("metadata", [("WARC-Record-ID", _uuid(F.concat(F.lit("metadata/"), F.col("cap")))), ("WARC-Concurrent-To", request_id), *about, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("languageHint: "), F.coalesce(F.regexp_extract("html", r'<html[^>]* lang="([A-Za-z\-]*)"', 1), F.lit("")), F.lit(NL)))
    text = F.concat(request, F.lit(END), F.when(revisit, again).otherwise(response), F.lit(END), meta)
    (rows.select(text.alias("value")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder))


def _parse(payloads: bool):
    def records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
        at, view = 0, memoryview(data)
        while (at := data.find(b"WARC/1.", at)) >= 0:
            stop = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:stop].decode().split(NL)[1:])
            size = int(head["Content-Length"])
            yield head, view[stop + 4 : stop + 4 + size]
            at = stop + 4 + size + 4

    def inflate(data: bytes) -> bytes:
        out = []
        while data:
            one = zlib.decompressobj(31)
            out.append(one.decompress(data))
            data = one.unused_data
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                data = inflate(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for head, block in records(data):
                    kind, body = head["WARC-Type"], bytes(block)
                    payload = body[body.index(b"\r\n\r\n") + 4 :] if head.get("Content-Type", "").startswith("application/http") else body
                    stated = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
                    page = head.get("X-Page-Id") or None
                    rows.append((head["WARC-Record-ID"], kind, head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), int(page) if page else None, found or stated, None if found is None else found == stated, None if kind == "revisit" else len(payload), list(head.items()), payload if payloads else None))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the WARC files (plain or gzip, of one or many members) under folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(_parse(payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, capture (response or revisit) and metadata, joined through WARC-Concurrent-To.

    A revisit takes payload length from the response that it refers to. A capture without request or metadata
    record keeps nulls there.
    """
    body = F.struct(*[F.col(x.split()[0]) for x in RECORD.split(", ")])
    side = lambda kinds, name: records.where(F.col("record_type").isin(*kinds)).select(F.coalesce("concurrent_to", "record_id").alias("transaction"), body.alias(name))
    main = side(["response", "revisit"], "capture")
    request = side(["request"], "request")
    meta = side(["metadata"], "metadata")
    sources = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("rid")).agg(F.first(F.struct(F.col("page_id").alias("page_id"), F.col("payload_bytes").alias("payload_bytes"))).alias("origin"))
    out = main.join(request, "transaction", "left").join(meta, "transaction", "left")
    wanted = main.where("capture.refers_to is not null").select(F.col("capture.refers_to").alias("rid")).distinct()
    sources = sources.join(wanted, "rid", "left_semi")
    return out.join(sources, F.col("capture.refers_to") == F.col("rid"), "left").select("transaction", "request", "capture", "metadata", "origin")


def op10_warc_transactions(spark, sf_dir: str) -> DataFrame:
    folder = workspace(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/warc")
    # parsed once: assemble() takes the records four times
    caps = assemble(materialise(read_warc(spark, f"{folder}/warc", payloads=False), folder, "records"))
    return caps.select(F.col("capture.page_id").alias("page_id"), F.coalesce("capture.payload_bytes", "origin.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.record_type").alias("record_type"), F.col("origin.page_id").alias("refers_to"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, hex,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b
"""
