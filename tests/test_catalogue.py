import pyarrow.parquet as pq
import pytest
from helpers import SF, oracle, same

from tracewright.operators import index
from tracewright.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF).toPandas(), oracle(catalogue.SQL[name]))


def test_ids_of_odd_keys(spark, tmp_path):
    """Keys with gaps, below zero, at the ends of their type and missing, with lines of an equal or no number."""
    keys = [None, -(1 << 63), -(1 << 40), -4097, -1, 0, 1, 4095, 4096, 5000, 1 << 24, (1 << 24) + 1, 1 << 62, (1 << 63) - 1]
    lines = [(k, n, part, part) for k in keys for n in (1, 2, 2, None) for part in (1, 2)]
    d = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    pq.write_table(d.toArrow(), f"{tmp_path}/lineitem.parquet")
    # as text, since pandas makes floats of keys beside a missing one
    cast = [f"cast({c} as varchar) as {c}" for c in ("archive_id", "line_no", "local_id", "doc_id")]
    got = catalogue.doc_ids(spark, str(tmp_path)).selectExpr(*[c.replace("varchar", "string") for c in cast])
    same(got.toPandas(), oracle(f"SELECT {', '.join(cast)} FROM ({catalogue.SQL['doc_ids']})", str(tmp_path)))


def test_ids_without_documents(spark):
    assert index.assign_ids(spark.createDataFrame([], "archive_id long, line_no long"), 7).collect() == []


def test_sums_before(spark):
    """Keys of several blocks, with a gap that takes every level."""
    keys = [*range(-6000, 6000), *((1 << 50) + 3 * i for i in range(6000))]
    counts = spark.createDataFrame([(k, 1 + k % 3) for k in keys], "__a long, __n long")
    want, total = {}, 0
    for k in keys:
        want[k], total = total, total + 1 + k % 3
    out = index._sums_before(counts, min(keys), max(keys))
    assert {r["__a"]: r["__before"] for r in out.collect()} == want


def test_filters_reach_the_scan(spark):
    plan = catalogue.archive_lookup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,33)]" in plan
    plan = catalogue.anomaly_list(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
