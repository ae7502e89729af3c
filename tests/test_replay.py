"""Replay windows against a fold over each key's times, in batch and as a stream."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.operators import replay
from tracewright.streaming import jobs


def fold(rows, ttl):
    keys, out = defaultdict(list), {}
    for d, r, e, t in rows:
        keys[d, r].append((t, e))
    for k, times in keys.items():
        since = None
        for t, e in sorted(set(times)):
            fresh = since is None or t - since >= ttl
            since = t if fresh else since
            out[*k, e] = not fresh
    return out


def made(seed, n=500):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), i, rng.choice([rng.randrange(-50, 60), rng.randrange(400), 10_000 + rng.randrange(3)])) for i in range(n)]
    return rows + [("one", "x", n, 5), ("one", "x", n, 5)]


@pytest.mark.parametrize("ttl", [1, 7, 50, 399, 100_000])
def test_chains(spark, tmp_path, ttl):
    rows = made(ttl)
    df = spark.createDataFrame(rows, "device_id string, request_id string, event_id long, ts_s long").repartition(3)
    got = replay.first_requests(df, ttl, f"file://{tmp_path}/r")
    assert {(r["device_id"], r["request_id"], r["event_id"]): r["replayed"] for r in got.collect()} == fold(rows, ttl) and got.count() == len(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "device_id string, request_id string, event_id long, ts_s long")
    assert replay.first_requests(df, 5, f"file://{tmp_path}/r").count() == 0


def test_the_stream_agrees(spark, tmp_path):
    """Batches in order of time give what the whole gives, and windows that ended leave no state."""
    rows = sorted([(d or "n", r, e, t + 1) for d, r, e, t in made(3, 300)[:-2] if 0 <= t < 1000], key=lambda r: r[3])
    df = spark.createDataFrame(rows, "device_id string, request_id string, event_id long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for k in range(3):
        lo, hi = (k * 133, (k + 1) * 133 if k < 2 else 10**6)
        df.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < hi)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.accepted_requests(source, ttl_s=40, late_s=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["device_id"], r["request_id"], r["event_id"]): r["replayed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == fold(rows, 40)
