import random
import re
from collections import Counter, defaultdict

from helpers import SF, oracle, same

from tracewright.llm import source_divergence as sd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    """The definition over plain dictionaries; rows are (lang, source, text)."""
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for g, s, t in rows]
    df, count = Counter(), defaultdict(Counter)
    for g, s, words in docs:
        df.update((g, w) for w in set(words))
        count[g, s].update(words)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for g in {g for g, _ in count}:
        kept = [w for (h, w), n in df.items() if h == g and n >= min_docs]
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        p = {s: shares(c) for (h, s), c in count.items() if h == g}
        q = shares(sum((c for (h, _), c in count.items() if h == g), Counter()))
        for s in p:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in p if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if count[g, s][w] > 0 and p[s][w] > q[w])[:top]
            out += [(g, s, part, i.decode(), -v, r) for part, ranked in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def rows(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "été", "ÉTÉ", "漢字", "a", "b-c", "x1y", *[f"w{chr(97 + rng.randrange(26))}" for _ in range(9)]])
    return [(rng.choice(["en", "en", "en", "fr", "xx", None]), rng.choice(["s0"] * 6 + ["s1", "S1", "é", "s2", None]), rng.choice([" ", ", ", "\n", "1"]).join(word() for _ in range(rng.randrange(14)))) for _ in range(n)]


def test_against_brute_force(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "lang string, source string, text string").repartition(3)
    assert got(sd.divergence(df, min_docs=6)) == brute(data, 6)
    assert got(sd.divergence(df, min_docs=2, top=3)) == brute(data, 2, 3)


def counted(batches):
    """The first scan on sorted rows, without Spark."""
    import pyarrow as pa

    return pa.Table.from_batches(sd._count_runs(2)(iter(batches)))


def test_scans_with_any_batches(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    data = sorted((rng.choice("ab"), rng.choice(["x", "y", "z"]), rng.choice(["s", "t", "u"]), i, 1, rng.randrange(1, 5)) for i in range(200))
    want = defaultdict(int)
    for g, w, s, _, _, n in data:
        want[g, w, s] += n
    whole = pa.Table.from_pylist([dict(zip(("lang", "term", "source", "block", "df", "n"), r, strict=True)) for r in data])
    for size in (1, 3, 50, 200):
        t = counted(whole.to_batches(max_chunksize=size))
        assert {(r["lang"], r["term"], r["source"]): r["n"] for r in t.to_pylist()} == want and t.num_rows == len(want)
    # bounds of what the second scan holds change what it emits, not the sums
    t = t.append_column("among", pa.array([100 + (r["source"] == "s") for r in t.to_pylist()])).append_column("among_lang", pa.array([300] * t.num_rows))
    results = []
    for pairs, terms in ((1 << 20, 100_000), (1, 1), (2, 3)):
        monkeypatch.setattr(sd, "PAIRS", pairs)
        monkeypatch.setattr(sd, "TERMS", terms)
        sums, best = Counter(), set()
        for b in sd._score_runs(2)(iter(t.to_batches(max_chunksize=4))):
            for r in b.to_pylist():
                if r["part"] == "pair":
                    sums[r["lang"], r["source"], r["item"]] += r["value"]
                else:
                    best.add((r["lang"], r["source"], -r["value"], r["item"]))
        results.append((sums, {g: sorted(x for x in best if x[:2] == g)[:2] for g in {x[:2] for x in best}}))
    assert results[0] == results[1] == results[2]


def test_pieces(monkeypatch):
    text = ("alpha BETA, gamma " * 50).encode()
    monkeypatch.setattr(sd, "PIECE", 7)
    assert [w for x in sd._words(text) for w in x] == [b"alpha", b"beta", b"gamma"] * 50
    assert [w for x in sd._words(b"x" * 30 + b" y") for w in x] == [b"x" * 30, b"y"]


def test_shares_beyond_64_bits():
    import numpy as np

    for n, among in ((10**13, 3 * 10**13), (0, 7), (5, 7), (10**14 - 3, 10**14), (123456789, 987654321987)):
        assert sd._share(np.array([n]), np.array([among]))[0] == 1 + 10**9 * (n + 2) // among


def test_query(spark):
    same(sd.query(spark, SF).toPandas(), oracle(sd.SQL))


def test_edges(spark, edge, empty):
    data = [(r["lang"], r["source"], r["text"]) for r in edge.collect()]
    assert got(sd.divergence(edge, min_docs=2)) == brute(data, 2)
    assert got(sd.divergence(edge, min_docs=1)) == brute(data, 1)
    assert got(sd.divergence(edge)) == brute(data)  # no kept term: pairs of value 0
    assert sd.divergence(empty).count() == 0
    clash = edge.selectExpr("lang", "source", "text", "1 AS n", "2 AS v", "3 AS rank", "4 AS item", "5 AS term")
    assert got(sd.divergence(clash, min_docs=2)) == brute(data, 2)
