"""Centroid clustering by delta Lloyd over integer vectors, exact at every step.

The vectors are kept as packed integers with their cluster and its squared
distance; each round reads that table and writes the next. A round compares a
vector with the changed centroids alone, and with all of them only where its
own cluster's centroid changed. What a round moves between clusters comes back
as signed integer sums, at most two for each cluster and batch, so the global
sums are carried on and never computed again. The driver holds centroids, sums
and counts: as many numbers as clusters times components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch

#: Bound on integer components, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Below this bound sums of products are exact in floating point, where they are faster.
EXACT = 1 << 22
#: Vectors that are compared at once.
BLOCK = 4096

STATE = "id long, v binary, cluster int, distance long, k int, delta array<long>, n long"
SCHEMA = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("k", pa.int32()), ("delta", pa.list_(pa.int64())), ("n", pa.int64())])


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exact."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)


def _unpack(packed: pa.Array, dims: int) -> np.ndarray:
    """Vectors from their packed form: the width of a component follows from the length."""
    raw = packed.to_pylist()
    out = np.empty((len(raw), dims), dtype=np.int64)
    widths = np.fromiter(map(len, raw), np.int64, len(raw)) // dims
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join([raw[i] for i in at]), dtype=f"<i{width}").reshape(-1, dims)
    return out


def _pack(v: np.ndarray) -> list[bytes]:
    small = np.abs(v).max(axis=1, initial=0) < 1 << 15
    return [row.astype("<i2" if s else "<i4").tobytes() for row, s in zip(v, small, strict=True)]


def _integers(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # the filter before has left whole, finite vectors only
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            v = np.floor(scale * x)
            if np.abs(v).max(initial=0) >= LARGEST:
                raise ValueError(f"a component is {LARGEST // scale} or more: squared distances would not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_pack(v.astype(np.int64)), pa.binary())], names=["id", "v"])

    return run


def _round(dims: int, centroids: np.ndarray, changed: np.ndarray, first: bool):
    """Assigns the vectors of a task; yields them and the signed sums that they move."""
    numbers = np.arange(len(centroids))

    def nearest(v: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(v, centroids[among])
        at = d.argmin(axis=1)  # the first of equals: the smaller number
        return among[at], d[np.arange(len(v)), at]

    def assign(v: np.ndarray, old: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if first:
            return nearest(v, numbers)
        to, dist = old.copy(), far.copy()
        stale = changed[old]
        if stale.any():
            to[stale], dist[stale] = nearest(v[stale], numbers)
        fresh = np.flatnonzero(~stale)
        among = numbers[changed]
        if len(fresh) and len(among):
            k, d = nearest(v[fresh], among)
            better = (d < dist[fresh]) | (d == dist[fresh]) & (k < to[fresh])
            to[fresh[better]], dist[fresh[better]] = k[better], d[better]
        return to, dist

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                v = _unpack(part.column(1), dims)
                old = np.full(len(v), -1) if first else part.column(2).to_numpy().astype(np.int64)
                far = np.zeros(len(v), np.int64) if first else part.column(3).to_numpy()
                to, dist = assign(v, old, far)
                n = len(v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(to, pa.int32()), pa.array(dist, pa.int64()), *[pa.nulls(n, t) for t in SCHEMA.types[4:]]], schema=SCHEMA)
                moved = np.flatnonzero(old != to)
                delta, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
                np.add.at(delta, to[moved], v[moved])
                np.add.at(count, to[moved], 1)
                left = moved[old[moved] >= 0]
                np.subtract.at(delta, old[left], v[left])
                np.subtract.at(count, old[left], 1)
                ks = np.flatnonzero(delta.any(axis=1) | (count != 0))
                if len(ks):
                    m = len(ks)
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(m, t) for t in SCHEMA.types[:4]], pa.array(ks, pa.int32()), pa.array(delta[ks].tolist(), SCHEMA.types[5]), pa.array(count[ks], pa.int64())], schema=SCHEMA)

    return run


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) of the kept vectors, and the centroids they are nearest to.

    Kept are vectors of ``dims`` components, none null or non-finite; component
    x becomes floor(scale * x). A component of 2^27 / scale or more raises
    ValueError, since squared distances would leave 64 bits. The first centroids
    are the k kept rows with the least sha256 of ``seed:id`` (equal ids: in
    the order of their packed bytes; null: the empty id). Fewer than k kept rows give as many
    centroids; repeated rows and vectors count each time; ties go to the smaller
    number. A cluster left empty keeps its centroid. No kept rows, no result rows.
    """
    spark = vectors.sparkSession
    base = scratch(spark)
    x = F.col(vector_col).cast("array<double>")
    whole = F.coalesce((F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(whole)
    kept.mapInArrow(_integers(dims, scale), "id long, v binary").write.parquet(path := f"{base}/vectors")
    state = spark.read.schema("id long, v binary").parquet(path)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [np.frombuffer(r["v"], dtype=f"<i{len(r['v']) // dims}").astype(np.int64) for r in state.orderBy(key, "v").limit(k).select("v").collect()]
    if not start:
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    centroids = np.stack(start)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    changed = np.ones(len(centroids), bool)
    for step in range(rounds + 1):
        old, path = path, f"{base}/{step}"
        state.mapInArrow(_round(dims, centroids, changed, step == 0), STATE).write.parquet(path)
        table = spark.read.schema(STATE).parquet(path)
        state = table.where("k IS NULL").select("id", "v", "cluster", "distance")
        _remove(spark, old)
        if step == rounds:
            break
        moved = table.where("k IS NOT NULL").select("k", "n", F.posexplode("delta").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in moved.collect():
            sums[r["k"], r["i"]] += r["x"]
            counts[r["k"]] += r["n"] if r["i"] == 0 else 0
        full = counts > 0
        after = centroids.copy()
        after[full] = sums[full] // counts[full, None]
        changed, centroids = (after != centroids).any(axis=1), after
        if not changed.any():
            break
    return state.select("id", "cluster", "distance"), centroids


def cluster_report(found: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """found with the inertia of each cluster and of all, and the digest of its centroid: one row of each cluster is sent to all tasks."""
    spark = found.sparkSession
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    named = F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster"))
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia")).first()[0]
    out = found.join(F.broadcast(own), "cluster")  # as many rows as clusters
    return out.select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), named.alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(*cluster(read_table(spark, sf_dir, "embeddings")))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same rounds as plain Lloyd: all sums anew in each."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v ORDER BY k LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, k := k)) AS m FROM (
    SELECT rid, k, (list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x))::BIGINT AS d FROM v, c{r} c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""e{r} AS (
  SELECT k, i, sum(y::BIGINT) AS s, count(*) AS n FROM (
    SELECT a.m.k AS k, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS i FROM v JOIN a{r} a USING (rid)) GROUP BY k, i),
f{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM e{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f{r} f USING (k))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.k = a.m.k"""


SQL = _sql()
