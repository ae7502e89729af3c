"""Roles of the driver's tables: documents and events as log documents, orders as archives, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(col: str):
    return F.unix_millis(F.col(col).cast("timestamp"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.size(tokens(F.col("text"))).cast("long").alias("term_count"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log documents: an error is an ERROR with one of five codes, a purchase a WARN."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return e.select(
        F.col("event_id").alias("doc_id"), ms("ts").alias("occurred_at_ms"), F.concat(F.lit("DEV-"), (F.col("user_id") % 50).cast("string")).alias("device_id"), t.alias("module_name"),
        F.when(t == "error", "ERROR").when(t == "purchase", "WARN").otherwise("INFO").alias("level"), F.when(t == "error", F.concat(F.lit("E"), (F.col("event_id") % 5).cast("string"))).otherwise("").alias("error_code"), "value", "props",
    )


LOG_SQL = """(SELECT event_id AS doc_id, epoch_us(ts) // 1000 AS occurred_at_ms, 'DEV-' || (user_id % 50) AS device_id, event_type AS module_name,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'error' THEN 'E' || (event_id % 5) ELSE '' END AS error_code, value, props FROM events)"""


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as archives: the status is the file type, the customer the device and work order."""
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("archive_id"), F.col("o_orderdate").cast("timestamp").alias("archived_at"), ms("o_orderdate").alias("archived_at_ms"), F.concat(F.lit("DEV-"), (F.col("o_custkey") % 50).cast("string")).alias("device_id"), F.concat(F.lit("ST-"), (F.col("o_custkey") % 7).cast("string")).alias("station_id"),
        F.concat(F.lit("WO-"), (F.col("o_custkey") % 20).cast("string")).alias("work_order"), F.when(s == "O", "RUNTIME_LOG").when(s == "F", "TEST_REPORT").otherwise("NG_IMAGE").alias("file_type"),
        F.when(s == "F", "PASS").when(s == "P", "NG").alias("result"), F.col("o_orderpriority").alias("state"), F.floor(F.col("o_totalprice")).cast("long").alias("file_size"), (F.col("o_orderkey") % 13).cast("long").alias("batch_id"),
    )


ARCHIVES_SQL = """(SELECT o_orderkey AS archive_id, epoch_us(o_orderdate) // 1000 AS archived_at_ms, 'DEV-' || (o_custkey % 50) AS device_id, 'ST-' || (o_custkey % 7) AS station_id,
  'WO-' || (o_custkey % 20) AS work_order, CASE o_orderstatus WHEN 'O' THEN 'RUNTIME_LOG' WHEN 'F' THEN 'TEST_REPORT' ELSE 'NG_IMAGE' END AS file_type,
  CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'P' THEN 'NG' END AS result, o_orderpriority AS state, floor(o_totalprice)::BIGINT AS file_size, o_orderkey % 13 AS batch_id FROM orders)"""

TOKENS_SQL = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_\-\x{80}-\x{10FFFF}]+'), lambda t: t <> '')"
TEXTS_SQL = f"(SELECT doc_id, text, lang, source, len({TOKENS_SQL})::BIGINT AS term_count FROM documents)"
POSTINGS_SQL = f"(SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY ALL)"
