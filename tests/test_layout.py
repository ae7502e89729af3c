"""Documents along a curve: filters and lookups read few row groups."""

from pyspark.sql import functions as F

from tracewright.operators import index


def rows_read(df):
    """Rows that the scans of a query gave to it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_row_groups(spark, tmp_path):
    n = 60_000
    k = F.col("id")
    docs = spark.range(n).select(k.alias("doc_id"), (k * 977 % 1_000_000).alias("occurred_at_ms"), F.concat(F.lit("D"), (k % 40).cast("string")).alias("device_id"), F.concat(F.lit("W"), (k * 31 % 300).cast("string")).alias("work_order"), F.sha2(k.cast("string"), 256).alias("event_name"))
    index.write_documents(docs, f"{tmp_path}/d", block_bytes=64 << 10)
    d = spark.read.parquet(f"{tmp_path}/d")
    assert d.count() == n and d.agg(F.count_distinct("doc_id")).first()[0] == n
    for some, most in ((d.where("doc_id = 31234"), 0.05), (d.where("occurred_at_ms BETWEEN 500000 AND 510000"), 0.5), (d.where("device_id = 'D7' AND occurred_at_ms BETWEEN 500000 AND 600000"), 0.25), (d.where("work_order = 'W5'"), 0.5)):
        want = some.count()
        assert want > 0 and rows_read(some) < most * n, (rows_read(some), most * n)


def test_curve(spark):
    got = spark.range(1).select(index.curve([F.lit(5).cast("long"), F.lit(3).cast("long")], 3).alias("x")).first()["x"]
    assert got == 0b011011  # bits of 101 and 011, the first in the lower place


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, occurred_at_ms long, device_id string, work_order string")
    index.write_documents(none, f"{tmp_path}/d")
    assert spark.read.schema(none.schema).parquet(f"{tmp_path}/d").count() == 0
