"""Transitions as a stream against the same of the whole table."""

import random

from pyspark.sql import functions as F

from tracewright.operators import sessions
from tracewright.streaming import timers


def streamed(spark, df, order, cuts, make, tmp_path):
    """Rows of the stream made from df in files cut by an order."""
    for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = df if lo is None else df.where(order >= lo)
        part = part if hi is None else part.where(order < hi)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def test_devices_turn_offline_once(spark, tmp_path):
    rng = random.Random(9)
    beats = [(f"D{d}", 1000 + t) for d in range(6) for t in sorted(rng.sample(range(3000), 30 if d else 1))]
    # a late beat of another device lets time pass for all
    beats.append(("clock", 90_000))
    df = spark.createDataFrame(beats, "device_id string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = streamed(spark, df, F.unix_seconds("ts"), [2000, 2500, 3000, 5000], lambda s: timers.device_transitions(s, 90, 1), tmp_path)
    want = [tuple(r) for r in sessions.device_transitions(df, 90).collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(r for r in want if not (r[0] == "clock" and r[1] == "OFFLINE"))
    states = {}
    for d, s, at in sorted(got, key=lambda r: (r[0], r[2], r[1])):
        assert s != states.get(d)
        states[d] = s
    assert all(s == "OFFLINE" for d, s in states.items() if d != "clock")


def test_files_seal_and_change(spark, tmp_path):
    rng = random.Random(2)
    scans = [(f"p{p}", n, rng.choice([5, 5, 5, 6]), rng.choice([1, 1, 2])) for p in range(5) for n in range(40)]
    df = spark.createDataFrame(scans, "path string, scan_no long, size long, mtime long")
    for stable in (1, 2, 3):
        got = streamed(spark, df, F.col("scan_no"), [7, 20, 21], lambda s, k=stable: timers.seal_events(s, k), tmp_path / str(stable))
        want = [tuple(r) for r in sessions.seal_events(df, stable).collect()]
        assert sorted(got) == sorted(want) and {e for _, _, e in got} == {"SEALED", "CHANGED"}
