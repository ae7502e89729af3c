"""Exact replay windows: a request is accepted unless an accepted one of its key is younger than ttl.

A key expires from its first use, not the last, so which times are accepted is
a chain: from an accepted time to the first one at least ttl later. Keys whose
times all lie within ttl have a chain of one, found by an aggregation. For the
others each time gets a pointer to the next, by bins of ttl: the next lies in
the following bin, or is the least of a later one, so a key's times are cut
into bins wherever they are many. Pointers are then doubled: after round r the
chain holds its first 2^r times, and a pointer leaps over as many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("device_id", "request_id")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_times(times: DataFrame, ttl: int) -> DataFrame:
    """(keys, at, next) for distinct (keys, at): the least time of the key that is at least ttl later, null at its end."""
    bin_ = F.call_function("div", F.col("at") - F.pmod(F.col("at"), F.lit(ttl)), F.lit(ttl).cast("long"))
    nodes = times.withColumn("bin", bin_)
    bins = nodes.groupBy(*KEYS, "bin").agg(F.min("at").alias("least"))
    # the least time of the bins after a bin's successor, and of the successor itself where there is one
    later = W.partitionBy(*KEYS).orderBy("bin")
    follow = lambda c, k: F.lead(c, k).over(later)
    jumps = bins.select(*KEYS, "bin", F.when(follow("bin", 1) == F.col("bin") + 1, follow("least", 2)).otherwise(follow("least", 1)).alias("far"))
    # times of a bin and the wishes of the bin before, in one order: a wish is met by the first time at or after it
    wish = nodes.select(*KEYS, (F.col("bin") + 1).alias("bin"), (F.col("at") + ttl).alias("x"), "at", F.lit(0).alias("kind"))
    there = nodes.select(*KEYS, "bin", F.col("at").alias("x"), F.lit(None).cast("long").alias("at"), F.lit(1).alias("kind"))
    back = W.partitionBy(*KEYS, "bin").orderBy(F.col("x").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, 0)
    met = wish.union(there).withColumn("near", F.last(F.when(F.col("kind") == 1, F.col("x")), ignorenulls=True).over(back)).where("kind = 0")
    met = met.select(*KEYS, (F.col("bin") - 1).alias("bin"), "at", "near")
    return met.join(jumps, [*KEYS, "bin"]).select(*KEYS, "at", F.coalesce("near", "far").alias("next"))


def accepted_times(times: DataFrame, ttl: int, base: str) -> DataFrame:
    """(keys, at) of the accepted ones of distinct times, by doubled pointers; each round is stored under base."""
    leaps = _stored(next_times(times, ttl).where("next IS NOT NULL"), f"{base}/next")
    chain = _stored(times.groupBy(*KEYS).agg(F.min("at").alias("at")), f"{base}/first")
    step = 0
    while not leaps.isEmpty():
        reached = chain.join(leaps, [*KEYS, "at"]).select(*KEYS, F.col("next").alias("at"))
        chain = _stored(chain.union(reached).distinct(), f"{base}/chain{step}")
        far = leaps.select(*KEYS, F.col("at").alias("next"), F.col("next").alias("beyond"))
        leaps = _stored(leaps.join(far, [*KEYS, "next"]).select(*KEYS, "at", F.col("beyond").alias("next")), f"{base}/leaps{step}")
        step += 1
    return chain


def first_requests(requests: DataFrame, ttl: int, base: str) -> DataFrame:
    """(keys, event_id, replayed) of requests (keys, event_id, ts_s): true within ttl of the last accepted one of the same device and id.

    Of rows with an accepted time the least event_id is accepted. Rows equal in
    key, time and event_id are one request. Null keys are keys like others.
    """
    plain = lambda c: F.struct(F.col(c).alias("v"))  # noqa: E731  nulls inside a struct equal each other
    rows = requests.select(*[plain(k).alias(k) for k in KEYS], "event_id", F.col("ts_s").cast("long").alias("at"))
    first = rows.groupBy(*KEYS).agg(F.min(F.struct("at", "event_id")).alias("one"), F.max("at").alias("last"))
    first = _stored(first, f"{base}/keys")
    long = first.where(F.col("last") - F.col("one.at") >= ttl).select(*KEYS)
    if long.isEmpty():
        accepted = first.select(*KEYS, "one")
        out = rows.join(accepted, list(KEYS)).withColumn("replayed", F.struct("at", "event_id") != F.col("one"))
    else:
        mine = rows.join(long, list(KEYS), "left_semi")
        chain = accepted_times(_stored(mine.select(*KEYS, "at").distinct(), f"{base}/times"), ttl, base)
        others = first.join(long, list(KEYS), "left_anti").select(*KEYS, F.col("one.at").alias("at"))
        at = others.union(chain)
        ones = rows.join(at, [*KEYS, "at"]).groupBy(*KEYS, "at").agg(F.min("event_id").alias("__one"))
        out = rows.join(ones, [*KEYS, "at"], "left").withColumn("replayed", ~F.col("event_id").eqNullSafe(F.col("__one")) | F.col("__one").isNull())
    return reduce(lambda df, k: df.withColumn(k, F.col(f"{k}.v")), KEYS, out.select(*KEYS, "event_id", "replayed"))
