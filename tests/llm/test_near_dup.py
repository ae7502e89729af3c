import random

import numpy as np

from helpers import SF, oracle, same

from tracewright.llm import near_dup as nd


def brute(rows, k, percent=80):
    """(set size, least reachable id) of each id by comparing all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, x in enumerate(ids):
        for y in ids[:a]:
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_against_all_pairs(spark):
    """Families of edited copies from light to heavy, chains, exact copies and a shared passage."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for family in range(6):
        base = [rng.choice(vocab) for _ in range(120)]
        for copy in range(25):
            t = list(base)
            for _ in range(rng.randint(0, 2 + family)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    chain = [rng.choice(vocab) for _ in range(200)]
    for i in range(20):
        texts.append(" ".join(chain[i * 5 : 100 + i * 5]))
    texts += [" ".join(common + [rng.choice(vocab) for _ in range(25)]) for _ in range(60)] + [texts[0]] * 10 + [None, "", "  ", "one two", "One  TWO"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(docs, k=4).collect()}
    assert got == brute(rows, 4)


def test_difference_join_is_exact(spark):
    """Every link around a leader that leaders leave is found from the differences alone."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    texts = [base]
    for group in range(4):
        far = list(base)
        for j in rng.sample(range(100), 12):
            far[j] = f"g{group}-{j}"
        for copy in range(6):
            t = list(far)
            for j in rng.sample(range(100), rng.randint(0, 3)):
                t[j] = f"c{group}-{copy}-{j}"
            texts.append(t)
    sets = [nd.shingle_set(" ".join(t), 4) for t in texts]
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    rows = [(0, i, len(s), jac(s, sets[0]) >= 0.8, np.setxor1d(s, sets[0]).view(np.int64).tolist()) for i, s in enumerate(sets) if i]
    delta = spark.createDataFrame(rows, "l long, y long, n long, linked boolean, delta array<bigint>")
    label = spark.createDataFrame([(r[1], 0) for r in rows if r[3]], "id long, component long")
    found = {(r["p"], r["q"]) for r in nd._by_difference(delta, label, 80).collect()}
    linked = {r[1] for r in rows if r[3]}
    true = {(a, b) for a in range(1, len(sets)) for b in range(a + 1, len(sets)) if jac(sets[a], sets[b]) >= 0.8 and not {a, b} <= linked}
    assert true and true <= found


def test_components(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    df = spark.createDataFrame(links, "x long, y long")
    got = {r["id"]: r["component"] for r in nd.components(df, f"file://{tmp_path}/cc").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def test_edges(spark, edge, empty):
    out = nd.near_duplicates(edge).collect()
    assert len(out) == edge.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[3] == {(1, 3)} and by[5] == {(17, 5)} and by[6] == {(17, 5)} and by[None] == {(1, None)}
    assert nd.near_duplicates(empty).count() == 0


def test_query_equals_sql(spark):
    same(nd.query(spark, SF).toPandas(), oracle(nd.SQL))
