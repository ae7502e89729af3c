import numpy as np
import pandas as pd
from helpers import SF

from tracewright.llm import packing
from tracewright.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    """Trained on the labels of even ids, measured on odd ones."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = qc.classify(docs, labels.where("doc_id % 2 = 0"), keep_text=False).select("doc_id", "kept", "p_junk", "p_toxic").toPandas()
    m = out.merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id")
    clean = m[(m.quality == 1) & (m.toxic == 0)]
    assert clean.kept.mean() > 0.99
    assert (~m[m.quality == 0].kept).mean() > 0.95 and (~m[m.toxic == 1].kept).mean() > 0.85


def test_sites_shrink(spark):
    """A path of one bad row stays near its host; a large bad host moves away from the global rate."""
    rows = [("h1", "a", 1000.0, 900.0, 0.0), ("h1", "b", 1.0, 1.0, 0.0), ("h2", "a", 1000.0, 50.0, 0.0), ("h3", "a", 1.0, 1.0, 0.0)]
    got = {(r["__host"], r["__path"]): r for r in qc._posteriors(spark.createDataFrame(rows, "__host string, __path string, n double, junk double, toxic double")).collect()}
    assert got["h1", "a"]["path_junk"] > 0.85 and got["h2", "a"]["path_junk"] < 0.1
    assert got["h3", "a"]["host_junk"] < 1 and got["h1", "b"]["path_junk"] < 1


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = qc.classify(edge, labels)
    rows = out.collect()
    assert len(rows) == edge.count() and set(edge.columns) < set(out.columns)
    assert not any(r["kept"] for r in rows if not (r["text"] or "").strip())
    assert all(r["kept"] for r in qc.classify(edge, labels.limit(0)).collect() if (r["text"] or "").strip())
    assert qc.classify(empty, labels).count() == 0


def test_pack_is_sound():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 4097, 500), rng.integers(1, 40, 500), np.full(300, 512), np.array([4096]), np.array([], dtype=np.int64)):
        bins, offsets, caps, fills = packing.pack(lengths)
        assert len(bins) == len(lengths)
        for b in range(len(caps)):
            mine = np.flatnonzero(bins == b)
            at = sorted((offsets[i], offsets[i] + lengths[i]) for i in mine)
            assert at[0][0] == 0 and all(x[1] == y[0] for x, y in zip(at, at[1:])) and at[-1][1] == fills[b] <= caps[b]
            assert caps[b] == min(c for c in packing.CAPACITIES if c >= fills[b])


def total(lengths, capacities=packing.CAPACITIES):
    return sum(packing.cost(int(c)) for c in packing.pack(lengths, capacities)[2])


def test_joint_sizes_beat_smaller_menus():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(300, 2000, 400), rng.integers(1, 4097, 400), np.minimum(4096, rng.lognormal(5.5, 1, 600).astype(int) + 1)):
        joint = total(lengths)
        assert joint <= min(total(lengths, (c, 4096)) for c in (512, 1024, 2048, 4096)) + 1e-9
        assert len(set(packing.pack(lengths)[2].tolist())) > 1


def least_cost(lengths):
    """The cheapest of all ways to share out the pieces."""
    sizes = sorted(packing.CAPACITIES)

    def go(i, fills):
        if i == len(lengths):
            return sum(packing.cost(next(s for s in sizes if s >= f)) for f in fills)
        ways = [go(i + 1, [*fills, lengths[i]])]
        ways += [go(i + 1, [*fills[:j], f + lengths[i], *fills[j + 1 :]]) for j, f in enumerate(fills) if f + lengths[i] <= sizes[-1]]
        return min(ways)

    return go(0, [])


def test_near_the_least_cost():
    rng = np.random.default_rng(5)
    found = []
    for i in range(100):
        lengths = rng.integers(50, 4000, rng.integers(2, 8)) if i % 2 else rng.integers(20, 1200, 7)
        found.append(total(lengths) / least_cost(lengths.tolist()))
    assert min(found) > 1 - 1e-9 and max(found) < 1.25 and np.mean(found) < 1.02


def test_packing_edges(spark, edge, empty):
    out = packing.pack_documents(edge).toPandas()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in edge.collect()}
    total = out.groupby("doc_id", dropna=False).n_tokens.sum()
    assert total.loc[4.0] == 27000 and total.loc[0.0] == 0 and total.loc[5.0] == 2 * words[5] and len(out[out.doc_id == 4]) == 7
    assert out[out.n_tokens == 0].bin_id.isna().all() and out[out.n_tokens > 0].bin_id.notna().all()
    assert (out[out.n_tokens > 0].groupby("bin_id").n_tokens.sum() <= out.groupby("bin_id").bin_capacity.first()).all()
    assert packing.pack_documents(empty).count() == 0
    assert isinstance(out, pd.DataFrame)


def test_site_posteriors_against_brute_force(spark):
    sites = [("a", "x", 400.0, 40.0, 0.0), ("a", "y", 2.0, 2.0, 0.5), ("a", "z", 30.0, 0.0, 0.0), ("b", "x", 1000.0, 900.0, 1.0), ("b", "y", 5.0, 1.0, 4.0), ("c", "x", 1.0, 1.0, 1.0), ("d", "x", 0.5, 0.0, 0.0)]
    got = {(r["__host"], r["__path"]): r for r in qc._posteriors(spark.createDataFrame(sites, "__host string, __path string, n double, junk double, toxic double")).collect()}
    assert len(got) == len(sites)
    total = sum(s[2] for s in sites)
    for col, name in ((3, "junk"), (4, "toxic")):
        mean = sum(s[col] for s in sites) / total

        def strength(spread, groups, mean=mean):
            tau = spread - mean * (1 - mean) * groups / total
            return 1e4 if tau <= 0 else min(1e4, max(1.0, mean * (1 - mean) / tau - 1))

        hosts = {h: (sum(s[2] for s in sites if s[0] == h), sum(s[col] for s in sites if s[0] == h)) for h in "abcd"}
        m = strength(sum(n * (b / n - mean) ** 2 for n, b in hosts.values()) / total, len(hosts))
        host = {h: (b + m * mean) / (n + m) for h, (n, b) in hosts.items()}
        k = strength(sum(s[2] * (s[col] / s[2] - host[s[0]]) ** 2 for s in sites) / total, len(sites))
        for s in sites:
            r = got[s[:2]]
            assert abs(r[f"host_{name}"] - host[s[0]]) < 1e-9 and abs(r[f"path_{name}"] - (s[col] + k * host[s[0]]) / (s[2] + k)) < 1e-9
        # a site of one row is drawn to the rate of all, one of many keeps its own
        assert abs(host["c"] - mean) < abs(1 - mean) and abs(host["b"] - hosts["b"][1] / hosts["b"][0]) < 0.02
