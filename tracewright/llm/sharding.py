"""Sharding by a hypergeometric communication matrix, with built-in functions only.

Rows fall into P logical partitions by a hash of their id, whatever the layout
of the files. A uniform shuffle sends a multivariate hypergeometric number of
rows from each partition to each shard. That P x S matrix is drawn on the
driver from the P counts; each partition then permutes its rows and cuts the
order by its matrix row, and each shard permutes what it got. Shard sizes are
exact: they differ by one at most. Only ids, sizes and checksums travel.
"""

from __future__ import annotations

import json
from math import e, lgamma, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table

#: Rows of a logical partition, on average: one task sorts that many slim rows.
PARTITION_ROWS = 20_000
#: Bound on the cells of the matrix, which the driver draws and sends out; P gives way to the number of shards.
MATRIX_CELLS = 1 << 20


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts by partition and shard: row sums as given, column sums at most one apart, all shufflings equally likely.

    Which shards get the extra rows is itself drawn. Partitions of zero rows give zero rows.
    """
    rng = np.random.default_rng(seed)
    total = sum(rows)
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        # one column after another, so that totals beyond the sampler's limit of 1e9 never meet it
        left, rest = n, int(room.sum())
        for s in range(shards):
            if not left:
                break
            good = int(room[s])
            rest -= good
            if not good:
                continue
            out[p, s] = left if rest == 0 else _hypergeometric(rng, good, rest, left)
            left -= int(out[p, s])
        room -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact; totals beyond the sampler's limit of 1e9 go through ratio-of-uniforms rejection, up to the rounding of lgamma."""
    return int(rng.hypergeometric(good, bad, draws)) if good + bad < 1_000_000_000 else _by_rejection(rng, good, bad, draws)


def _by_rejection(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Hypergeometric draw by ratio of uniforms under a table mountain hat (Stadlober 1990)."""
    few, many, total = min(good, bad), max(good, bad), good + bad
    n = min(draws, total - draws)
    if not n or not few:
        return good if draws == total else (min(draws, good) if not bad else 0)
    log_p = lambda k: -(lgamma(k + 1) + lgamma(few - k + 1) + lgamma(n - k + 1) + lgamma(many - n + k + 1))
    p = few / total
    center, width = n * p + 0.5, (n * p * (1 - p) * (total - n) / (total - 1) + 0.5) ** 0.5
    hat = 2 * (2 / e) ** 0.5 * width + 3 - 2 * (3 / e) ** 0.5
    top = log_p((n + 1) * (few + 1) // (total + 2))
    end = min(min(n, few) + 1, int(center + 16 * width))
    while True:
        u, v = rng.random(), rng.random()
        x = center + hat * (v - 0.5) / u if u else -1.0
        if 0 <= x < end and 2 * log(u) <= log_p(int(x)) - top:
            k = int(x)
            break
    # undo the two reflections
    k = n - k if good > bad else k
    return k if n == draws else good - k


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A driver-side table as a literal: no Python on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240229, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Rows of (id, size, text_crc32, shard, slot): every row of docs once.

    Null texts have size 16 and checksum 0; null ids form one more value to
    hash. Rows equal in id, size and checksum are interchangeable, so ties
    leave the result defined. An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"))
    total = docs.count()
    parts = max(1, min(MATRIX_CELLS // shards, -(-total // partition_rows)))
    # repeated ids differ in their checksum; equal rows stay together, at most what one text repeated under one id amounts to
    slim = slim.withColumn("part", F.pmod(F.xxhash64("id", "crc", F.lit(seed)), F.lit(parts)).cast("int"))
    counts = dict(slim.groupBy("part").count().collect())
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = matrix.cumsum(axis=1)
    key = [F.col(c) for c in ("id", "crc", "size")]
    order = W.partitionBy("part").orderBy(F.xxhash64("id", "crc", F.lit(seed + 1)), *key)
    cuts = _small(spark, [{"part": p, "ends": e} for p, e in enumerate(ends.tolist())], "part int, ends array<bigint>")
    ranked = slim.withColumn("rank", F.row_number().over(order) - 1)
    dealt = ranked.join(cuts, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))

    # the second permutation: pieces by the leading part of a fresh key, then the order inside each piece
    pieces = max(1, -(-total // (shards * partition_rows)))
    dealt = dealt.withColumn("k2", F.xxhash64("id", "crc", F.lit(seed + 2)))
    dealt = dealt.withColumn("piece", F.pmod(F.shiftright("k2", 32), F.lit(pieces)).cast("int")).select("id", "size", "crc", "shard", "piece", "k2")
    if pieces == 1:
        offsets = None
    else:
        n = dealt.groupBy("shard", "piece").count()
        offsets = n.select("shard", "piece", (F.sum("count").over(W.partitionBy("shard").orderBy("piece")) - F.col("count")).alias("before"))
    local = F.row_number().over(W.partitionBy("shard", "piece").orderBy("k2", *key)) - 1
    out = dealt.withColumn("local", local)
    out = out.withColumn("before", F.lit(0)) if offsets is None else out.join(offsets, ["shard", "piece"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("local")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
