import hashlib
import random
from collections import Counter

from helpers import SF, oracle, same

from tracewright.llm import line_dedup as ld

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, min_docs, min_length=1):
    """(id, kept text, lines, dropped) of each row, each row a document."""
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, x in texts for k in {key(y) for y in x} if len(k) >= min_length)
    out = []
    for i, x in texts:
        kept = [y for y in x if held.get(key(y), 0) < min_docs]
        out.append((i, "\n".join(kept), len(x), len(x) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def rows(seed, n=120):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", " ", "Menu", " menu\t", "Ménu", "MÉNU", "a b", "A B\r", *[f"line {rng.randrange(60)}" for _ in range(4)], f"own {rng.random()}"])
    return [(i if rng.random() < 0.9 else None, "\n".join(line() for _ in range(rng.randrange(9)))) for i in range(n)]


def test_against_brute_force_with_any_batches(spark):
    for seed, (batches, fanout, min_docs) in enumerate([(1, 2, 3), (5, 2, 4), (7, 3, 10), (4, 9, 2)]):
        data = rows(seed)
        df = spark.createDataFrame(data, "doc_id long, text string")
        assert got(ld.dedup_lines(df, min_docs=min_docs, batches=batches, fanout=fanout)) == brute(data, min_docs)
    assert got(ld.dedup_lines(df, min_docs=2, min_length=4)) == brute(data, 2, 4)


def test_runs_settle_keys_and_stay_few(spark, tmp_path):
    runs = ld.LineRuns(spark, f"file://{tmp_path}/runs-1", min_docs=6, buckets=2, fanout=2)
    total = Counter()
    for b in range(9):
        keys = [(k, -k) for k in range(b, 20) for _ in range(1 + k % 2)]
        total.update(k for k, _ in keys)
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long"))
        found = [r["h1"] for r in runs.frequent().collect()]
        assert sorted(found) == sorted(k for k, n in total.items() if n >= 6)
        assert all(len(x) < 2 for x in [*runs.open.values(), *runs.settled.values()])
    settled = [r["h1"] for r in runs._all(runs._names(runs.settled)).collect()]
    assert settled and len(settled) == len(set(settled))
    names = runs._names(runs.open) + runs._names(runs.settled)
    plan = runs._without_settled(spark.table(names[0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name in names]


def test_query_and_plan(spark):
    df = ld.query(spark, SF)
    same(df.toPandas(), oracle(ld.SQL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark, edge, empty):
    data = [(r["doc_id"], r["text"]) for r in edge.collect()]
    out = ld.dedup_lines(edge, min_docs=2)
    assert got(out) == brute(data, 2)
    assert set(out.columns) == set(edge.columns) | {"n_lines", "n_dropped"}
    clash = edge.selectExpr("doc_id", "text", "1 AS r1", "2 AS at", "3 AS n_lines", "'x' AS batch", "4 AS row")
    out = ld.dedup_lines(clash, min_docs=2)
    assert got(out) == brute(data, 2) and {r["r1"] for r in out.collect()} == {1}
    assert ld.dedup_lines(empty).count() == 0
    many = [(1, "same\nx" * 3000), *[(2, "same")] * 40, (3, None), (3, "")]
    df = spark.createDataFrame(many, "doc_id long, text string")
    assert got(ld.dedup_lines(df)) == brute(many, 10)
    text = ld.dedup_lines(df).where("doc_id = 1").first()["text"]
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(brute(many, 10)[0][1].encode()).hexdigest()
