"""What queries of one session share: an index of the texts, and a log index over files of log lines, each stored once for a state of the tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks, index
from ..sources.files import Archive, read_files
from .log_index import LogIndex
from .roles import log, table, texts

_MADE: dict[tuple, object] = {}
#: A term has bitmaps if one in so many documents holds it.
BITMAP_SHARE = 64
MAX_FILES = 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def _once(spark: SparkSession, sf: str, name: str, make):
    """What make gives, made once for a session and the files of a table as they are."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))
    key = (spark.sparkContext.applicationId, make.__name__, files)
    if key not in _MADE:
        _MADE[key] = make(spark, sf)
    return _MADE[key]


@dataclass
class TextIndex:
    docs: DataFrame
    blocks: DataFrame
    bitmaps: DataFrame
    documents: int
    average: float

    def best(self, terms: list[str], k: int) -> DataFrame:
        return blocks.best(self.blocks, terms, self.documents, self.average, k)

    def scores(self, terms: list[str]) -> DataFrame:
        """(doc_id, bm25) of all documents that hold every term."""
        df = blocks.frequencies(self.blocks, terms)
        if any(t not in df for t in terms):
            return self.docs.select("doc_id", F.lit(0.0).alias("bm25")).limit(0)
        return blocks.scores(self.blocks, terms, self.documents, self.average, df)

    def with_all(self, terms: list[str]) -> DataFrame:
        """doc_id of the documents that hold every term: by bitmaps where all terms have them, else by their blocks."""
        known = self.bitmaps.where(F.col("term").isin(*terms)).select("term").distinct().count()
        return blocks.members(blocks.intersected(self.bitmaps, terms)) if known == len(set(terms)) else blocks.documents_with(self.blocks, terms)


def text_index(spark: SparkSession, sf: str) -> TextIndex:
    """The texts' block-max postings, bitmaps of frequent terms, and lengths."""
    return _once(spark, sf, "documents", _text_index)


def _text_index(spark: SparkSession, sf: str) -> TextIndex:
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    blocks.write(blocks.build(table(spark, sf, "documents").select("doc_id", "text")), f"{root}/blocks", by_term=False)
    rows = spark.read.parquet(f"{root}/blocks")
    # a document's length stands in each of its postings; documents without a term are counted by their ids alone
    lengths = rows.select(F.explode(F.arrays_zip("ids", "lens")).alias("p")).select(F.col("p.ids").alias("doc_id"), F.col("p.lens").cast("long").alias("term_count")).distinct()
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(lengths, "doc_id", "left").withColumn("term_count", F.coalesce("term_count", F.lit(0).cast("long")))
    d.write.parquet(f"{root}/documents")
    docs = spark.read.parquet(f"{root}/documents")
    s = index.corpus_stats(docs).first()
    often = rows.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") * BITMAP_SHARE >= s["documents"]).select("term")
    blocks.bitmaps(rows.join(often, "term", "left_semi")).repartitionByRange("term").sortWithinPartitions("term", "bucket").write.parquet(f"{root}/bitmaps")
    return TextIndex(docs, rows, spark.read.parquet(f"{root}/bitmaps"), s["documents"], s["average_length"])


@dataclass
class Logs:
    archives: DataFrame
    files: Archive
    profiles: DataFrame
    index: LogIndex


def logs(spark: SparkSession, sf: str) -> Logs:
    """events as log files, one for each device, scanned, built and merged into a log index."""
    return _once(spark, sf, "events", _logs)


def log_line() -> F.Column:
    code = F.when(F.col("error_code") == "", "-").otherwise(F.col("error_code"))
    return F.concat_ws(" ", S.ms_to_iso(F.col("occurred_at_ms")), *[F.concat(F.lit(f"{k}="), c) for k, c in {"level": "level", "module": "module_name", "device": "device_id", "code": code}.items()])


def _logs(spark: SparkSession, sf: str) -> Logs:
    """Files of 50 devices; that of DEV-7 has no profile, those of DEV-11 and DEV-13 are recorded with another digest and size, that of DEV-17 ends with a line that is none."""
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    rows = log(spark, sf).select("device_id", "doc_id", log_line().alias("value"))
    broken = rows.where("device_id = 'DEV-17'").select("device_id").distinct().select("device_id", F.lit(1 << 62).alias("doc_id"), F.lit("no  log line").alias("value"))
    rows.union(broken).repartition("device_id").sortWithinPartitions("device_id", "doc_id").select("device_id", "value").write.partitionBy("device_id").text(f"{root}/files")
    k = F.regexp_extract("relative_path", r"DEV-(\d+)/", 1).cast("long")
    there = read_files(spark, f"{root}/files", "*.txt").select(k.alias("k"), "relative_path", "length", "sha256")
    same = {"line_id": "L1", "station_id": "ST-1", "collector_id": "C1", "file_type": "RUNTIME_LOG", "original_filename": "device.log"}
    a = there.select(
        (F.col("k") + 1).alias("archive_id"), *[F.lit(v).alias(c) for c, v in same.items()], F.concat(F.lit("DEV-"), F.col("k").cast("string")).alias("device_id"), F.lit(None).cast("string").alias("work_order"), F.lit(None).cast("string").alias("product_sn"), "relative_path",
        (F.col("length") + F.when(F.col("k") == 13, 1).otherwise(0)).alias("file_size"), F.when(F.col("k") == 11, F.reverse("sha256")).otherwise(F.col("sha256")).alias("file_sha256"), *[F.lit("2031-02-03").cast("timestamp").alias(c) for c in ("produced_at", "archived_at")],
    )
    a.write.parquet(f"{root}/archives")
    archives = spark.read.parquet(f"{root}/archives")
    profiles = archives.where("device_id <> 'DEV-7'").select("device_id", "file_type", F.lit("kv_runtime_v1").alias("profile_name"))
    x, files = LogIndex(spark, f"{root}/index"), Archive(spark, f"{root}/files")
    x.run(lambda: archives, files, lambda: profiles, cycles=-(-archives.count() // MAX_FILES) + 1, poll_s=0, max_files=MAX_FILES, max_documents=1 << 40)
    x.compact(fanout=2)
    return Logs(archives, files, profiles, x)
