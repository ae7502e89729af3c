"""Quality rules and decontamination against their SQL, plain Python and edge cases."""

import hashlib
import random
import re

from helpers import SF, oracle, same
from pyspark.sql import functions as F

from tracewright.llm import decontaminate as dc
from tracewright.llm import quality_rules as qr


def test_rules_equal_sql(spark):
    same(qr.query(spark, SF).toPandas(), oracle(qr.SQL))


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 500 else None
    return len(words), sum(map(len, words)), hit and len(hit)


def test_rules_on_edges(spark, edge, empty):
    rows = qr.apply_rules(edge).collect()
    assert len(rows) == edge.count() and rows[0].asDict().keys() == {*edge.columns, "quality"}
    for r in rows:
        n, chars, hit = counts(r["text"])
        assert (r["quality"]["n_words"], r["quality"]["word_chars"]) == (n, chars)
        if hit is not None:
            assert r["quality"]["n_repeat_words"] == (hit or 0)
        assert n >= 50 or (r["quality"]["base_failed"] and not r["quality"]["kept"])
    assert rows[4]["quality"]["n_repeat_words"] == 27000
    assert qr.apply_rules(empty).count() == 0
    cased = "THE CAT (AND) THE DOG, OF COURSE: 'IS' IT? ".split() * 1
    docs = spark.createDataFrame([(" ".join(f"{w}{i}" if j == 1 else w for i in range(9) for j, w in enumerate(cased)),)], "text string")
    assert docs.select(qr.measures(F.col("text")).alias("m")).first()["m"]["w"]["n_stop"] == 9 * 6
    assert "Exchange" not in qr.apply_rules(edge)._jdf.queryExecution().executedPlan().toString()


def test_decontamination_equals_sql(spark):
    same(dc.query(spark, SF).toPandas(), oracle(dc.SQL))


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, met, starts = words(t), set(), set(), {}
        for n in {min(10, len(words(x))) for _, x in items} - {0}:
            for j in range(len(w) - n + 1):
                starts.setdefault((n, tuple(w[j : j + n])), []).append(j)
        for k, it in items:
            x = words(it)
            n = min(10, len(x))
            for s in {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else ():
                for j in starts.get((n, s), ()):
                    hit |= set(range(j, j + n))
                    met.add(k)
        out[i] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest())
    return out


def test_winnowing_selects_in_every_window(spark):
    """Each window holds a selected gram, namely its least, the last on ties; short lengths have grams of their own."""
    rng = random.Random(3)
    texts = [[rng.choice("abcdefgh"[:kinds]) for _ in range(n)] for kinds in (1, 2, 8) for n in (0, 4, 9, 10, 11, 60)]
    df = spark.createDataFrame([(t,) for t in texts], "w array<string>")
    for length, gram in ((10, 5), (7, 5), (5, 5), (3, 5), (1, 5)):
        got = df.select("w", dc.let(F.col("w"), lambda w: dc.winnow(w, length, gram)).alias("s"), dc.let(F.col("w"), lambda w: dc.window_hashes(w, min(gram, length))).alias("h")).collect()
        span = length - min(gram, length) + 1
        for r in got:
            h = r["h"]
            want = sorted({max(range(i, i + span), key=lambda j: (-h[j], j)) for i in range(len(h) - span + 1)})
            assert [(x["at"], x["fp"]) for x in r["s"]] == [(p, h[p]) for p in want]


def test_decontamination_on_edges(spark, edge, empty):
    items = [(2, "cat sat on THE mat, and it was there for all of us"), (10, "one"), (11, None), (12, "!!"), (13, "viktor quer"), (3, "the cat sat on the mat and it was there"), (3, "the cat sat on the mat and it was there"), (14, "b c a b c a b c a b c a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = edge.where("doc_id IS NOT NULL")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    for words_ in (dc.BITMAP_HIGH, 0):
        rows = dc.decontaminate(docs, bench, bitmap_words=words_).collect()
        assert len(rows) == docs.count()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows} == want
    assert want[3][1:3] == (1, 1) and want[8][1] == 2 and want[5][2] == 2 and want[4][1] > 26000
    assert dc.decontaminate(empty, bench).count() == 0
    clean = dc.decontaminate(edge, bench.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == edge.count()
    nothing = spark.createDataFrame([(None, None), (1, "the cat sat on the mat and it was there for all")], "item_id long, text string")
    assert [(r["n_items"], r["contaminated"]) for r in dc.decontaminate(edge.where("doc_id = 5"), nothing).collect()] == [(1, True)] * 2


def test_decontamination_of_random_passages(spark):
    """Passages around the window's length, repeated words and items inside items, with and without the bitmap."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 3, 5, 7, 9, 10, 11, 25))))) for i in range(25)]
    docs = []
    for i in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)[1].split()
            a = rng.randrange(len(x))
            at = rng.randrange(len(t) + 1)
            t[at:at] = x[a : a + rng.randrange(1, 26)]
        docs.append((i, " ".join(t)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for words_ in (dc.BITMAP_HIGH, 0):
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in dc.decontaminate(d, b, bitmap_words=words_).collect()} == want
