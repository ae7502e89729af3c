"""Request columns against the checks of single requests."""

import random

from tracewright.operators import archive_queries, requests, search

TEXTS = [None, None, None, "D-1", "", "x" * 129, "a\nb", "é", "x" * 128]


def refused(check, q):
    try:
        check(q)
    except ValueError as e:
        return str(e)
    return None


def times(rng):
    low = rng.choice([None, 946_684_800_000 - 1, 946_684_800_000, 1_700_000_000_000])
    span = rng.choice([0, -1, 31 * 86_400_000, 31 * 86_400_000 + 1, 5])
    return low, (low + span if low is not None else None) if rng.random() < 0.9 else 1_700_000_000_000


def test_searches(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        t = {c: rng.choice(TEXTS) if rng.random() < 0.25 else None for c in search.TEXT_FILTERS}
        words = [rng.choice(["abc", "a b", "", "...", "é", "x" * 65, "ok"]) for _ in range(rng.choice([0, 1, 1, 2, 9]))] if rng.random() < 0.4 else ["ok"]
        levels = [rng.choice(["INFO", "WARN", "ERROR", "DEBUG"]) for _ in range(rng.randrange(5))] if rng.random() < 0.3 else []
        low, high = times(rng) if rng.random() < 0.5 else (None, None)
        rows.append((i, words, *t.values(), levels, low, high, rng.choice([0, 0, 5, -1, 990, 10**12]), rng.choice([1, 50, 200, 201, 0])))
    schema = "i int, keywords array<string>, " + ", ".join(f"{c} string" for c in search.TEXT_FILTERS) + ", levels array<string>, time_from long, time_to long, offset long, page_size long"
    got = requests.search_failures(spark.createDataFrame(rows, schema)).collect()
    want = {}
    for i, words, *rest in rows:
        q = search.SearchQuery(words, **dict(zip([*search.TEXT_FILTERS, "levels", "time_from", "time_to", "offset", "page_size"], rest, strict=True)))
        want[i] = refused(search.validate, q)
    assert {r["i"]: r["failure"] for r in got} == want and len(set(want.values())) > 8


def test_archive_lists(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        t = [rng.choice(TEXTS) if rng.random() < 0.3 else None for _ in archive_queries.FILTERS]
        low, high = times(rng) if rng.random() < 0.5 else (None, None)
        rows.append((i, *t, low, high, rng.choice([None, 1, 100, 101, 0])))
    schema = "i int, " + ", ".join(f"{c} string" for c in archive_queries.FILTERS) + ", time_from long, time_to long, page_size int"
    want = {}
    for i, *rest in rows:
        *t, low, high, size = rest
        q = archive_queries.ArchiveQuery(*t, low, high, page_size=archive_queries.DEFAULT_PAGE if size is None else size)
        want[i] = (refused(archive_queries.validate, q), q.page_size)
    got = requests.archive_failures(spark.createDataFrame(rows, schema)).collect()
    assert {r["i"]: (r["failure"], r["page_size"]) for r in got} == want and len({f for f, _ in want.values()}) > 6
