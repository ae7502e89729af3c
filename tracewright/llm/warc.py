"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record, tied by WARC-Concurrent-To. Records are built by column
expressions and written by Spark's text sink, whose line separator is the two
CRLFs that end a record, so any store that Spark writes to will do. Archives
hold a bounded number of captures, fewer of them the larger their payloads, and
are compressed as a whole file. They are read back as binary files, parsed by Content-Length in Arrow batches, and the
records are joined through their concurrent-to identifiers into one nested row
per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, scratch, stored

CRLF = "\r\n"
CAPTURES_PER_FILE = 2000
#: Payloads up to this many bytes share a file by CAPTURES_PER_FILE; a class of STEP times the bytes has a STEP-th of the captures.
SMALL_BYTES, STEP = 65_536, 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are eight groups of 20 bits, four letters each."""

    def group(h: Column, i: Column) -> Column:
        n = F.conv(F.substring(h, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return let(n, lambda v: F.concat(*[F.substring(F.lit(BASE32), F.floor(v / (1 << (15 - 5 * j))).cast("int") % 32 + 1, F.lit(1)) for j in range(4)]))

    return let(F.sha1(data), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: group(h, i)), ""))


def _record(kind: str, rid: Column, headers: list[tuple[str, Column]], block: Column, mime: str) -> Column:
    """One record without the CRLF pair that ends it."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: "), _urn(rid)]
    for name, value in headers:
        lines += [F.lit(f"{CRLF}{name}: "), value]
    return let(block, lambda b: F.concat(*lines, F.lit(f"{CRLF}Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(b).cast("string"), F.lit(CRLF + CRLF), b))


def _urn(rid: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), rid, F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, captures_per_file: int = CAPTURES_PER_FILE, small_bytes: int = SMALL_BYTES) -> None:
    """Writes every row of pages as a capture. Among equal payloads of min_bytes or more, the largest id responds and the others revisit it.

    Null payloads are empty, null urls empty; a url's line breaks are percent-encoded.
    Repeated rows of the largest id all respond. Rows with a null id respond
    only where no other row has their payload. An empty table writes no capture.
    Payloads of a file amount to captures_per_file * small_bytes at most, unless
    it holds a single capture; each size class is a folder under path.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), body.alias("body"), base32_sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    # what the payloads are is stored once: which of them repeat and which size classes there are follows without their bytes
    slim = stored(pages.select(F.col(id_col).alias("id"), F.sha1(body.cast("binary")).alias("hex"), F.octet_length(body).alias("n")), f"{path}-payloads")
    again = slim.where(F.col("n") >= min_bytes)
    # only payloads met more than once need a look-up; stored, so that its size is known when the join is planned
    again = stored(again.groupBy("hex").agg(F.count("*").alias("c"), F.max("id").alias("first")).where("c > 1").select("hex", "first"), f"{path}-again")
    rows = rows.withColumn("hex", F.sha1(F.col("body").cast("binary"))).join(again, "hex", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    rows = rows.select("id", "url", "body", "digest", "n", revisit.alias("revisit"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    tied = ("WARC-Concurrent-To", _urn(F.col("rs")))
    host, path_ = F.regexp_extract("url", r"://([^/?#]*)", 1), F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path_.startswith("/"), path_).otherwise(F.concat(F.lit("/"), path_)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    fields = F.concat(F.lit("captureId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF))
    first = F.when(F.col("revisit"), _record("revisit", F.col("rs"), [target, digest, ("WARC-Profile", F.lit(PROFILE))], http, "application/http; msgtype=response")).otherwise(_record("response", F.col("rs"), [target, digest], F.concat(http, F.col("body")), "application/http; msgtype=response"))
    records = F.concat_ws(CRLF + CRLF, _record("request", F.col("rq"), [target, tied], asked, "application/http; msgtype=request"), first, _record("metadata", F.col("md"), [target, tied], fields, "application/warc-fields"))
    largest = slim.agg(F.max("n")).first()[0] or 0
    classes = [(-1, small_bytes)]
    while classes[-1][1] < largest:
        classes.append((classes[-1][1], classes[-1][1] * STEP))
    counts = slim.agg(*[F.count_if((F.col("n") > low) & (F.col("n") <= high)) for low, high in classes]).first()
    # the pages are read once more for each class that has any; the first is written also where it has none
    for low, high in [c for c, n in zip(classes, counts, strict=True) if n or c[0] < 0]:
        # ids are drawn after the filter, which would not get past them to the scan
        some = rows.where((F.col("n") > low) & (F.col("n") <= high)).withColumns({c: F.expr("uuid()") for c in ("rq", "rs", "md")})
        some.select(records.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(1, captures_per_file * small_bytes // high)).text(f"{path}/to-{high}")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(headers, start, end) of each record's block; header names are lower-cased. Raises ValueError where the framing is broken."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = head + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at its length")
        yield headers, start, end
        at = end + 4


_SCHEMA = "file string, kind string, record_id string, concurrent_to string, target_uri string, date string, digest string, capture_id string, payload_bytes long, payload_digest string, payload binary"


def _reader(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else bytes(content)
                out = []
                for h, start, end in parse_records(data):
                    kind, bare = h.get("warc-type"), lambda k, h=h: h[k].strip("<>") if k in h else None
                    row = [name, kind, bare("warc-record-id"), bare("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None, None]
                    if kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in data[start:end].decode("utf-8", "replace").split(CRLF) if ": " in x)
                        row[7] = fields.get("captureId") or None
                    elif kind in ("response", "revisit"):
                        body = data.find(b"\r\n\r\n", start, end) + 4
                        if kind == "response":
                            row[8], row[9] = end - body, base64.b32encode(hashlib.sha1(data[body:end]).digest()).decode()
                            row[10] = data[body:end] if with_payload else None
                        else:  # the length that the capture's own HTTP header states
                            length = [x.split(b":")[1] for x in data[start:body].lower().split(b"\r\n") if x.startswith(b"content-length:")]
                            row[8], row[9] = int(length[0]) if length else None, row[6]
                    out.append(row)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return read


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under path, at any depth; payload digests are computed from the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_reader(with_payload), _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request, metadata and, for a revisit, refers_to.

    Requests and metadata meet their response through its record id. Several of
    a kind give the least by record id and are counted; those of an unknown
    response are left out, a response without them has nulls. A revisit refers
    to the response with its payload digest, the largest capture id on ties.
    """
    main = records.where("kind IN ('response', 'revisit')")
    tied = records.where("concurrent_to IS NOT NULL")

    def side(kind: str, *cols: str) -> DataFrame:
        return tied.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", *cols)).alias(kind), F.count("*").alias(f"n_{kind}"))

    out = main.join(side("request", "target_uri", "date"), "record_id", "left").join(side("metadata", "capture_id"), "record_id", "left")
    out = out.select(
        F.col("metadata.capture_id").alias("capture_id"), "kind", "target_uri",
        F.struct("record_id", "file", "date", "payload_bytes", "payload_digest", "payload").alias("response"), "request", "metadata",
        F.coalesce("n_request", F.lit(0)).alias("n_request"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )
    targets = out.where("kind = 'response'").groupBy(F.col("response.payload_digest").alias("d")).agg(F.max(F.col("capture_id").cast("long")).alias("to"))
    revisits = out.where("kind = 'revisit'").withColumn("d", F.col("response.payload_digest")).join(targets, "d", "left").drop("d").withColumnRenamed("to", "refers_to")
    return out.where("kind = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark)
    write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{base}/warc")
    records = stored(read_records(spark, f"{base}/warc").drop("payload"), f"{base}/records").withColumn("payload", F.lit(None).cast("binary"))
    out = assemble(records)
    return out.select(F.col("capture_id").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) AS v FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((n >> s) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""
