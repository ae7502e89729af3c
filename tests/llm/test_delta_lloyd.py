import hashlib

import numpy as np
import pytest
from helpers import SF, oracle, same

from tracewright.llm import delta_lloyd as dl


def brute(rows, k, rounds, dims, scale=256, seed=2):
    """Plain Lloyd over Python integers: id, cluster, squared distance, and the centroids."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cents


def check(spark, rows, k, rounds, dims, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    found, cents = dl.cluster(df, k=k, rounds=rounds, dims=dims)
    want, at = brute(spark.createDataFrame(rows, df.schema).rdd.map(tuple).collect(), k, rounds, dims)
    assert cents.tolist() == at
    assert sorted(map(tuple, found.collect()), key=repr) == want
    return found, cents


def test_against_plain_lloyd(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for seed, (n, k, rounds, dims, spread) in enumerate([(300, 7, 5, 3, 0.02), (200, 40, 3, 2, 1.0), (60, 5, 0, 4, 3.0)]):
        rows = [(i, (spread * rng.normal(size=dims)).tolist()) for i in range(n)]
        check(spark, rows, k, rounds, dims, parts=seed + 1)
    monkeypatch.setattr(dl, "EXACT", 1)
    monkeypatch.setattr(dl, "BLOCK", 17)
    check(spark, rows, 5, 4, 4)


def test_rounds_compare_changed_centroids_only(spark, monkeypatch):
    seen = []
    real = dl._round
    monkeypatch.setattr(dl, "_round", lambda dims, c, changed, first: seen.append(int(changed.sum())) or real(dims, c, changed, first))
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)] + [(100 + i, [50.0 + i, 9.0]) for i in range(7)]
    check(spark, rows, 6, 9, 2)
    assert seen[0] == 6 and min(seen) < 6 and len(seen) < 10  # ends once nothing changes


def test_moved_vectors_carry_the_sums(spark):
    cents = np.array([[0, 0], [10, 0]])
    packed = dl._pack(np.array([[1, 0], [9, 0], [-40000, 7]]))
    assert [len(x) for x in packed] == [4, 4, 8]
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(packed), pa.array([0, 0, 1], pa.int32()), pa.array([1, 81, 5])], names=["id", "v", "cluster", "distance"])
    rows = [r for out in dl._round(2, cents, np.array([False, True]), False)(iter([b])) for r in out.to_pylist()]
    assert [(r["id"], r["cluster"]) for r in rows if r["k"] is None] == [(1, 0), (2, 1), (3, 0)]
    assert [(r["k"], r["delta"], r["n"]) for r in rows if r["k"] is not None] == [(0, [-40009, 7], 0), (1, [40009, -7], 0)]


def test_query(spark):
    same(dl.query(spark, SF).toPandas(), oracle(dl.SQL))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [0.25, 1.0]), (None, [3.0, 3.0]), (None, None), (4, [1.0]), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, -inf]), (10, [1.0, 2.0, 3.0]), (11, [-0.001, 0.0])]
    found, cents = check(spark, rows, 40, 5, 2)
    assert len(cents) == 5 and found.count() == 5
    report = dl.cluster_report(found, cents)
    assert {r["inertia"] for r in report.collect()} == {sum(r["distance"] for r in found.collect())}
    none = spark.createDataFrame([(4, [1.0])], "vec_id long, embedding array<float>")
    assert dl.cluster_report(*dl.cluster(none)).count() == 0 and dl.cluster(none.limit(0))[0].count() == 0
    clash = spark.createDataFrame([(i, [float(i), 0.0], 7, "x") for i in range(9)], "vec_id long, embedding array<float>, cluster int, v string")
    assert dl.cluster(clash, k=2, dims=2)[0].count() == 9
    with pytest.raises(Exception, match="squared distances"):
        dl.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), dims=2)
    big = [(i, [5e5 * (-1) ** i, 5e5 - i]) for i in range(8)]
    check(spark, big, 3, 4, 2)
