"""Parsed batches as JSON lines with a manifest, and the checks that a reader makes before it trusts one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas

ARCHIVES = "archive_id long, file_size long, file_sha256 string, relative_path string, document_count long"
INHERITED = ("line_id", "station_id", "device_id")


def write(archives: DataFrame, docs: DataFrame, batch_id: int, path: str) -> None:
    """archives.jsonl, documents.jsonl and manifest.json under path, which must not exist; the manifest comes last and counts and digests the rest."""
    spark = docs.sparkSession
    archives.write.mode("error").json(f"{path}/archives.jsonl", ignoreNullFields=False)
    docs.write.mode("error").json(f"{path}/documents.jsonl", ignoreNullFields=False)
    row = {"batch_id": batch_id} | _measure(spark, path)
    spark.range(1).select(F.lit(json.dumps(row, sort_keys=True)).alias("value")).coalesce(1).write.mode("error").text(f"{path}/manifest.json")


def _measure(spark: SparkSession, path: str) -> dict:
    """Counts and order-free digests of the written lines: the sum of a hash of each, so no task reads a whole part."""
    out = {}
    for name in ("archives", "documents"):
        t = spark.read.text(f"{path}/{name}.jsonl")
        r = t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).alias("d")).first()
        out |= {f"{name}_count": r["n"], f"{name}_digest": str(r["d"])}
    return out


def read(spark: SparkSession, path: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(archives, documents) of a sound artifact; ValueError names what is broken."""
    lines = spark.read.text(f"{path}/manifest.json").collect()
    manifest = json.loads(lines[0]["value"]) if len(lines) == 1 else {}
    if manifest != {"batch_id": batch_id} | _measure(spark, path):
        raise ValueError("the manifest does not describe the files")
    archives = spark.read.schema(ARCHIVES + ", " + ", ".join(f"{c} string" for c in INHERITED)).option("mode", "FAILFAST").json(f"{path}/archives.jsonl")
    docs = spark.read.schema(schemas.DOCUMENT).option("mode", "FAILFAST").json(f"{path}/documents.jsonl")
    bad = [r["rule"] for r in violations(archives, docs).collect()]
    if bad:
        raise ValueError(f"broken artifact: {', '.join(bad)}")
    return archives, docs


def violations(archives: DataFrame, docs: DataFrame) -> DataFrame:
    """(rule, n): repeated archives, gaps in local_id, counts by file that differ, documents without their archive or with another's metadata."""
    per = docs.groupBy("archive_id").agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in INHERITED:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}"))
    checks = [
        ("repeated_archive", archives.groupBy("archive_id").count().agg(F.count_if(F.col("count") > 1).alias("n"))),
        ("local_id_not_contiguous", docs.agg(((F.count("*") > 0) & ((F.count("*") != F.count_distinct("local_id")) | (F.min("local_id") != 0) | (F.max("local_id") != F.count("*") - 1))).cast("long").alias("n"))),
        ("document_count_differs", archives.join(per, "archive_id", "full").agg(F.count_if(~F.coalesce("document_count", F.lit(-1)).eqNullSafe(F.coalesce("n", F.lit(0).cast("long")))).alias("n"))),
        ("metadata_differs", docs.alias("d").join(archives.alias("a"), "archive_id").agg(F.count_if(~same).alias("n"))),
    ]
    out = None
    for rule, q in checks:
        row = q.select(F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        out = row if out is None else out.union(row)
    return out.where("n > 0")
