"""Block-max postings against scores of every document."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import blocks, index, search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        n = rng.randrange(3, 60)
        words = [f"w{min(int(rng.expovariate(0.25)), 30)}" for _ in range(n)] + (["rare"] * (1 + 9 * (i == 1777)) if i % 97 == 0 or i == 1777 else [])
        rows.append((i, " ".join(words), "ERROR" if i % 11 == 0 else "INFO", i % 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, level string, occurred_at_ms long").withColumn("error_code", F.lit("")).cache()
    b = blocks.build(docs).cache()
    n, total = docs.count(), sum(len(r[1].split()) for r in rows)
    return rows, docs, b, n, total / n


def brute(rows, terms, n, average):
    texts = {i: t.split() for i, t, *_ in rows}
    df = {t: sum(t in w for w in texts.values()) for t in terms}
    part = lambda w, t: blocks.idf(n, df[t]) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average))
    return {i: sum(part(w, t) for t in sorted(terms)) for i, w in texts.items() if all(t in w for t in terms)}


@pytest.mark.parametrize("terms", [["w0"], ["w3", "w0"], ["rare"], ["w20", "w25"], ["rare", "w1", "w2"], ["none"], ["w0", "none"]])
@pytest.mark.parametrize("k", [1, 10, 400])
def test_best(spark, corpus, terms, k, monkeypatch):
    monkeypatch.setattr(blocks, "FIRST_BLOCKS", 2)
    rows, docs, b, n, average = corpus
    want = brute(rows, terms, n, average)
    got = {r["doc_id"]: r["bm25"] for r in blocks.best(b, terms, n, average, k).collect()}
    assert all(want[i] == pytest.approx(s, abs=1e-12) for i, s in got.items())
    top = sorted(want.values(), reverse=True)[:k]
    assert sorted(got.values(), reverse=True)[: len(top)] == pytest.approx(top)
    assert blocks.count_hits(b, terms).first()[0] == len(want) and sorted(r[0] for r in blocks.documents_with(b, terms).collect()) == sorted(want)


def test_blocks_that_cannot_enter_are_not_scored(spark, corpus, monkeypatch):
    monkeypatch.setattr(blocks, "FIRST_BLOCKS", 2)
    rows, _, b, n, average = corpus
    every = blocks.scores(b, ["rare"], n, average, blocks.frequencies(b, ["rare"])).count()
    near = blocks.best(b, ["rare"], n, average, 1)
    assert near.count() < every and near.orderBy(F.desc("bm25")).first()["doc_id"] == 1777


def test_bounds_hold_and_blocks_are_in_order(corpus):
    rows, _, b, n, average = corpus
    df = blocks.frequencies(b, ["w0", "w5"])
    bound = {r["block"]: r["bound"] for r in blocks.bounds(b, ["w0", "w5"], n, average, df).collect()}
    for i, s in brute(rows, ["w0", "w5"], n, average).items():
        assert s <= bound[i >> blocks.BLOCK_BITS] + 1e-9
    for r in b.collect():
        assert r["ids"] == sorted(set(r["ids"])) and r["n"] == len(r["ids"]) == len(r["tfs"]) == len(r["lens"]) and r["max_tf"] == max(r["tfs"]) and r["min_len"] == min(r["lens"])


def test_bitmaps(corpus):
    rows, _, b, _, _ = corpus
    maps = blocks.bitmaps(b).cache()
    for terms in (["w0"], ["w0", "w2", "w9"], ["rare", "w4"], ["none", "w0"]):
        want = [i for i, t, *_ in rows if set(terms) <= set(t.split())]
        both = blocks.intersected(maps, terms)
        assert sorted(r[0] for r in blocks.members(both).collect()) == want
        assert (both.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0) == len(want)


def test_engine_with_and_without_blocks(corpus):
    rows, docs, b, n, average = corpus
    posts = index.postings(docs)
    d = index.corpus_stats(docs.select(F.size(F.split("text", " ")).cast("long").alias("term_count")))
    full = docs.withColumn("term_count", F.size(F.split("text", " ")).cast("long"))
    terms = posts.groupBy("term").agg(F.count("*").alias("df"))
    plain, fast = (search.SearchEngine(full, posts, d, terms, [1], x) for x in (None, b))
    for q in (search.SearchQuery(["w0"], page_size=20), search.SearchQuery(["w2 w7"], offset=5, page_size=30), search.SearchQuery(["rare"], levels=["ERROR"]), search.SearchQuery(["w1"], anomaly_only=True, page_size=5), search.SearchQuery(["none"])):
        a, c = plain.search(q, guarded=False), fast.search(q, guarded=False)
        assert a.total_hits == c.total_hits
        assert [(r["doc_id"], round(r["score"], 9)) for r in a.items.collect()] == [(r["doc_id"], round(r["score"], 9)) for r in c.items.collect()]


def test_texts_are_exchanged_once(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("of the"), F.col("id") % 7, F.col("id") % 7).alias("text"))
    b = blocks.build(docs, part_bytes=1000)
    assert b._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert b.groupBy("term", "block").count().where("count > 1").isEmpty()
    rows = {(r["term"], r["block"]): (r["ids"], r["tfs"], r["lens"]) for r in b.collect()}
    ids = {t: [i for (w, _), (x, _, _) in sorted(rows.items(), key=lambda r: r[0][1]) for i in x if w == t] for t in ("of", "3")}
    assert ids == {"of": list(range(3000)), "3": [i for i in range(3000) if i % 7 == 3]}
    assert {x for (w, _), (_, tfs, lens) in rows.items() if w == "3" for x in zip(tfs, lens, strict=True)} == {(2, 4)}
