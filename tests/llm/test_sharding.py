import zlib
from collections import Counter

import numpy as np

from tracewright.llm import sharding as sh


def test_matrix_margins_and_law():
    rows = [5, 0, 17, 3]
    total = np.zeros((4, 3))
    for seed in range(2000):
        m = sh.communication_matrix(rows, 3, seed)
        assert m.sum(axis=1).tolist() == rows and m.min() >= 0 and np.ptp(m.sum(axis=0)) <= 1
        total += m
    assert np.allclose(total / 2000, np.array(rows)[:, None] / 3, atol=0.15)
    big = sh.communication_matrix([10**9, 3 * 10**9], 4, 1)
    assert big.sum() == 4 * 10**9 and set(big.sum(axis=0)) == {10**9}


def check(rows, out, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r["shard"] for r in out)
    per = [sizes.get(s, 0) for s in range(shards)]
    assert sum(per) == len(rows) and max(per) - min(per) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes.get(s, 0)))


def test_shards_against_the_law(spark):
    rows = [(i, f"t{i % 7}é") for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (10_000, 100, 5):
        out = sh.shard_rows(df, 8, partition_rows=part).collect()
        check(rows, out, 8)
    again = sh.shard_rows(df.repartition(7), 8, partition_rows=5).collect()
    key = lambda x: (x["doc_id"], x["shard"], x["slot"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert "Python" not in sh.shard_rows(df, 8)._jdf.queryExecution().executedPlan().toString()


def test_fewer_partitions_where_the_matrix_is_full(spark, monkeypatch):
    monkeypatch.setattr(sh, "MATRIX_CELLS", 24)
    rows = [(i, f"t{i % 7}") for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sh.shard_rows(df, 8, partition_rows=5).collect(), 8)
    check(rows, sh.shard_rows(df, 40, partition_rows=5).collect(), 40)


def test_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    check(rows, sh.shard_rows(edge, 4).collect(), 4)
    assert sh.shard_rows(empty).count() == 0


def test_rejection_has_the_same_law():
    for good, bad, draws in ((40, 60, 30), (60, 40, 30), (30, 70, 80), (500, 200, 600), (5, 1000, 10)):
        a, b = np.random.default_rng(1), np.random.default_rng(2)
        x = np.array([sh._by_rejection(a, good, bad, draws) for _ in range(6000)])
        y = b.hypergeometric(good, bad, draws, 6000)
        assert x.min() >= max(0, draws - bad) and x.max() <= min(good, draws)
        assert abs(x.mean() - y.mean()) < 0.1 * y.std() + 0.02 and abs(x.std() - y.std()) < 0.06 * y.std() + 0.02
    assert sh._by_rejection(np.random.default_rng(1), 7, 0, 3) == 3 and sh._by_rejection(np.random.default_rng(1), 0, 7, 3) == 0 and sh._by_rejection(np.random.default_rng(1), 4, 3, 7) == 4
