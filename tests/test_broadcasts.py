"""What goes through the driver: no join broadcasts a table with a row for each line, document or report, however small its files look."""

import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import SF
from tracewright.functions.scalars import doc_id
from tracewright.operators import index
from tracewright.plans.catalogue import doc_ids
from tracewright.plans.record_queries import report_outcomes
from tracewright.sources import files as source

LINES, FILES = 400, 3


@pytest.fixture(autouse=True)
def planned_only(spark):
    """What Spark broadcasts once it has seen the real size is left out."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def broadcast_rows(df):
    """The rows of the largest table that the plan broadcast when it ran."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_line_scan(spark, tmp_path):
    body = b"a line\n" * LINES
    bodies = {f"{i}.log": body for i in range(FILES)} | {"mark.log": b"\xef\xbb\xbf"}
    (tmp_path / "files").mkdir()
    for name, data in bodies.items():
        (tmp_path / "files" / name).write_bytes(data)
    scan = source.Archive(spark, f"file://{tmp_path}/files").scan(list(bodies), f"file://{tmp_path}/scan")
    assert {r["relative_path"]: r["sha256"] for r in scan.digests().collect()} == {k: hashlib.sha256(b).hexdigest() for k, b in bodies.items()}
    assert scan.lines().count() == FILES * LINES + 1
    assert broadcast_rows(scan.digests()) <= FILES + 1
    assert broadcast_rows(scan.lines()) <= FILES + 1


def test_reports(spark):
    out = report_outcomes(spark, SF)
    assert out.count() > 100
    assert broadcast_rows(out) <= 1


def _documents(spark, path):
    n = F.col("id")
    fixed = {c: F.lit("x") for c in ("line_id", "station_id", "device_id", "level", "module_name")}
    d = spark.range(LINES * FILES).select((n % FILES).alias("archive_id"), n.alias("line_no"), F.lit(0).cast("long").alias("byte_offset"), F.lit(1).cast("long").alias("byte_length"), n.alias("occurred_at_ms"), F.lit(1).cast("long").alias("term_count"), *[v.alias(c) for c, v in fixed.items()])
    d.write.parquet(path)
    return spark.read.parquet(path)


def test_ids_of_a_batch(spark, tmp_path):
    out = index.assign_ids(_documents(spark, f"{tmp_path}/d"), 7)
    assert sorted(r["local_id"] for r in out.collect()) == list(range(LINES * FILES))
    assert broadcast_rows(out) <= FILES


def test_ids_of_many_archives(spark, tmp_path):
    docs = _documents(spark, f"{tmp_path}/d").withColumn("archive_id", F.col("line_no") * 1000)
    out = index.assign_ids(docs, 7)
    assert {r["archive_id"]: r["local_id"] for r in out.collect()} == {i * 1000: i for i in range(LINES * FILES)}
    assert broadcast_rows(out) <= 1
    assert broadcast_rows(doc_ids(spark, SF)) <= 1


def test_rules_of_a_segment(spark, tmp_path):
    d = index.assign_ids(_documents(spark, f"{tmp_path}/d"), 7)
    d.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    docs.select(F.lit("w").alias("term"), "doc_id", F.lit(1).cast("long").alias("tf")).union(spark.range(1).select(F.lit("w"), doc_id(F.lit(9).cast("long"), F.col("id")), F.lit(1).cast("long"))).write.parquet(f"{tmp_path}/postings")
    posts = spark.read.parquet(f"{tmp_path}/postings")
    files = spark.range(FILES).select(F.col("id").alias("archive_id"), F.lit(9).cast("long").alias("file_size"))
    rules = index.violations(docs, files, posts, index.term_dictionary(posts))
    assert [tuple(r) for r in rules.collect()] == [("posting_without_document", 1)]
    assert broadcast_rows(rules) <= FILES
