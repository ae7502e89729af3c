"""Queries over requests and rows of the tables: bounds of searches and lists, guards, line limits, archive rows of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive_queries, parsers, requests
from ..sources import archives as archive_source
from .catalogue import entry
from .roles import ARCHIVES_SQL, archives, ms, table


@entry("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'DEV' END AS device, o_orderpriority AS word, CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE 'WARN' END AS level,
  CASE WHEN o_custkey % 2 = 0 THEN epoch_us(o_orderdate) // 1000 END AS a, CASE WHEN o_custkey % 2 = 0 THEN epoch_us(o_orderdate) // 1000 + (o_custkey % 40) * 86400000 END AS b, o_orderkey % 1200 AS off, o_custkey % 250 AS size FROM orders)
SELECT k, CASE WHEN level = 'URGENT' THEN 'bad levels' WHEN b - a > 31 * 86400000::BIGINT OR a < 946684800000 THEN 'bad time range' WHEN word = '5-LOW' THEN 'bad keywords'
  WHEN device IS NULL AND a IS NULL THEN 'a selective filter is required' WHEN size < 1 OR size > 200 OR off + size > 1000 THEN 'page out of bounds' END AS failure FROM r""")
def search_requests(spark, sf):
    """A search for each order: levels, ranges, keywords, selectivity and pages from its columns, judged by the rules of searches."""
    o, k = table(spark, sf, "orders"), F.col("o_custkey")
    none = {c: F.lit(None).cast("string") for c in ("line_id", "station_id", "work_order", "product_sn", "module_name", "error_code")}
    at = F.when(k % 2 == 0, ms("o_orderdate"))
    word = F.when(F.col("o_orderpriority") == "5-LOW", "...").otherwise(F.col("o_orderpriority"))
    r = o.select(
        F.col("o_orderkey").alias("k"), F.array(word).alias("keywords"), *[c.alias(n) for n, c in none.items()], F.when(k % 3 == 0, "DEV").alias("device_id"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "URGENT").otherwise("WARN")).alias("levels"),
        at.alias("time_from"), (at + (k % 40) * 86_400_000).alias("time_to"), (F.col("o_orderkey") % 1200).alias("offset"), (k % 250).alias("page_size"),
    )
    return requests.search_failures(r).select("k", "failure")


@entry("""WITH r AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'WO-' || o_custkey WHEN 'P' THEN '' END AS wo, CASE WHEN o_orderkey % 4 < 2 THEN epoch_us(o_orderdate) // 1000 END AS a, (o_custkey % 40 - 2) * 86400000 AS span, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 130 END AS size FROM orders)
SELECT k, CASE WHEN wo = '' THEN 'bad work_order' WHEN a IS NOT NULL AND (span < 0 OR span > 31 * 86400000::BIGINT) THEN 'bad time range' WHEN wo IS NULL AND a IS NULL THEN 'a selective filter is required' WHEN coalesce(size, 50) NOT BETWEEN 1 AND 100 THEN 'bad page size' END AS failure, coalesce(size, 50) AS page_size FROM r""")
def archive_requests(spark, sf):
    """An archive list for each order, with the default page size where none is given."""
    o, k, s = table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderstatus")
    at = F.when(F.col("o_orderkey") % 4 < 2, ms("o_orderdate"))
    none = {c: F.lit(None).cast("string") for c in ("station_id", "product_sn", "file_type", "result")}
    r = o.select(F.col("o_orderkey").alias("k"), F.lit("DEV").alias("device_id"), *[c.alias(n) for n, c in none.items()], F.when(s == "O", F.concat(F.lit("WO-"), k.cast("string"))).when(s == "P", "").alias("work_order"), at.alias("time_from"), (at + (k % 40 - 2) * 86_400_000).alias("time_to"), F.when(k % 5 > 0, k % 130).alias("page_size"))
    return requests.archive_failures(r).select("k", "failure", "page_size")


@entry("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS line FROM documents), l AS (SELECT doc_id, text, CASE WHEN suffix(line, chr(13)) THEN line[1 : -2] ELSE line END AS line FROM d)
SELECT doc_id AS archive_id, CASE WHEN text = '' THEN 'RUNTIME_LOG_EMPTY' WHEN strlen(line) > 400 THEN 'LINE_TOO_LONG' WHEN line = '' OR NOT contains(line, ' ') THEN 'RUNTIME_LOG_FORMAT_INVALID' ELSE 'RUNTIME_LOG_TIME_INVALID' END AS failure_code, CASE WHEN text <> '' THEN 1 END::INTEGER AS failure_line FROM l""")
def line_limit(spark, sf):
    """Texts as runtime logs, which none of them is: what the first line fails by, its length before all else."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("archive_id"), F.col("text").cast("binary").alias("content"), F.col("doc_id").cast("string").alias("relative_path"))
    d = d.withColumns({"length": F.octet_length("content"), "sha256": F.sha2("content", 256)})
    same = {"line_id": "L", "station_id": "S", "device_id": "D", "collector_id": "C", "work_order": "", "product_sn": "", "file_type": "RUNTIME_LOG"}
    a = d.select("archive_id", "relative_path", F.col("length").alias("file_size"), F.col("sha256").alias("file_sha256"), *[F.lit(v).alias(c) for c, v in same.items()], F.lit("2031-02-03").cast("timestamp").alias("archived_at"))
    profiles = spark.range(1).select(F.lit("D").alias("device_id"), F.lit("RUNTIME_LOG").alias("file_type"), F.lit("kv_runtime_v1").alias("profile_name"))
    return parsers.parse_archives(a, d.select("relative_path", "length", "sha256", "content"), profiles, 400)[1].select("archive_id", "failure_code", F.col("failure_line").cast("int").alias("failure_line"))


@entry(f"SELECT archive_id, file_type, file_size FROM {ARCHIVES_SQL} WHERE archive_id > 0 AND file_size > 0")
def guarded_rows(spark, sf):
    """Archive rows that the guard lets through as they are; it ends the query at any other."""
    a = archives(spark, sf).where("archive_id > 0 AND file_size > 0")
    same = {c: F.lit("x") for c in ("line_id", "collector_id", "original_filename", "relative_path")}
    return archive_source.decode_guard(a.withColumns(same | {"file_sha256": F.sha2(F.col("archive_id").cast("string"), 256), "produced_at": F.col("archived_at")})).select("archive_id", "file_type", "file_size")


@entry(f"SELECT archive_id::VARCHAR AS upload_id, work_order, result, file_size FROM {ARCHIVES_SQL} WHERE state IN ('1-URGENT', '2-HIGH') AND archive_id % 2 = 0")
def session_archives(spark, sf):
    """Archive rows of the sessions that are verified or archived and have a place."""
    a = archives(spark, sf)
    state = F.when(F.col("state") == "1-URGENT", "VERIFYING").when(F.col("state") == "2-HIGH", "ARCHIVED").otherwise("UPLOADING")
    same = {c: F.lit("x") for c in ("line_id", "collector_id", "product_sn", "original_filename", "file_sha256")}
    s = a.withColumns(same | {"upload_id": F.col("archive_id").cast("string"), "state": state, "relative_path": F.when(F.col("archive_id") % 2 == 0, "p"), "produced_at": F.col("archived_at")})
    return archive_queries.archive_record(s).select("upload_id", "work_order", "result", "file_size")
