import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewright.functions.scalars import canonical_request, hmac_sha256
from tracewright.operators import archive_queries, cache, search, service, sessions
from tracewright.sources import files as source
from tracewright.streaming import jobs


def test_query_validation():
    ok = search.SearchQuery(["camera"], device_id="D")
    assert search.validate(ok) is ok
    for bad in (search.SearchQuery(["camera"]), search.SearchQuery(["..."], device_id="D"), search.SearchQuery(device_id=""), search.SearchQuery(device_id="D", levels=["DEBUG"]), search.SearchQuery(device_id="D", offset=900, page_size=200), search.SearchQuery(device_id="D", offset=2**32 - 1, page_size=1), search.SearchQuery(device_id="D", time_from=10**12), search.SearchQuery(time_from=10**12, time_to=10**12 + 32 * 86_400_000)):
        with pytest.raises(search.InvalidQuery):
            search.validate(bad)
    for bad in (archive_queries.ArchiveQuery(device_id="D"), archive_queries.ArchiveQuery(work_order="W", page_size=101), archive_queries.ArchiveQuery(work_order="")):
        with pytest.raises(ValueError):
            archive_queries.validate(bad)


def test_keyset_pages(spark):
    a = spark.createDataFrame([(i, "W", dt.datetime(2026, 1, 1 + i // 2)) for i in range(1, 8)], "archive_id long, work_order string, archived_at timestamp")
    seen, cursor = [], None
    while True:
        rows, more, token = archive_queries.page(a, archive_queries.ArchiveQuery(work_order="W", page_size=3, cursor=cursor))
        seen += [r["archive_id"] for r in rows]
        if not more:
            break
        cursor = (int(rows[-1]["archived_at"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000), rows[-1]["archive_id"])
        assert len(token) == 22
    assert seen == [7, 6, 5, 4, 3, 2, 1]


def test_hand_built_segment(spark):
    d = spark.createDataFrame([(0, 2, "INFO", "", 1), (1, 3, "INFO", "", 2), (2, 2, "ERROR", "E1", 3)], "doc_id long, term_count long, level string, error_code string, occurred_at_ms long")
    p = spark.createDataFrame([("camera", 0, 1), ("camera", 1, 1), ("camera", 2, 1), ("ng", 2, 1), ("timeout", 0, 1), ("timeout", 1, 2)], "term string, doc_id long, tf long")
    stats = spark.createDataFrame([(3, 7)], "documents long, total_terms long")
    e = search.SearchEngine(d, p, stats, p.groupBy("term").agg(F.count("*").alias("df")), [1])
    page = e.search(search.SearchQuery(["camera timeout"]), guarded=False)
    got = [(r["doc_id"], r["score"]) for r in page.items.collect()]
    assert page.total_hits == 2 and got == [(1, pytest.approx(0.7177436143391505, abs=1e-12)), (0, pytest.approx(0.6409958163311709, abs=1e-12))]
    assert e.search(search.SearchQuery(error_code="E1")).items.first()["score"] == 5.0
    assert e.search(search.SearchQuery(["camera"], offset=3), guarded=False).items.count() == 0


def test_slru():
    c = cache.SegmentedLru(2, 1)
    for k in (1, 2):
        c.put(k, k)
    assert (c.get(1), c.get(2)) == (1, 2)
    c.put(3, 3)
    c.put(4, 4)
    assert c.get(1) is None and c.get(2) == 2 and len(c) <= 3


def test_cache_keys_and_pages(spark):
    q = lambda *k: cache.query_key(search.SearchQuery(list(k), device_id="D"), 1)
    assert q("a b", "c") == q("c", "B", "a") != cache.query_key(search.SearchQuery(["a b c"], device_id="D"), 2)
    page = cache.dump_page(1, 2, [5, 6], [1.0, 0.5])
    assert cache.parse_page(page)["doc_ids"] == [5, 6]
    for bad in ("{", page.replace('"format": 1', '"format": 2'), page.replace("[5, 6]", "[5]"), page.replace("5, 6", "true, 6")):
        with pytest.raises(search.InvalidQuery):
            cache.parse_page(bad)
    now = 10**12
    ttl = lambda r, to, e: spark.range(1).select(cache.ttl_seconds(F.lit(r), F.lit(to), F.lit(now), F.lit(e)).alias("t")).first()["t"]
    old = now - 7_200_000 - 1
    assert [ttl(False, old, False), ttl(True, old + 1, True), ttl(True, old, False), ttl(True, old, True)] == [30, 10, 600, 300]


def test_sessions():
    led = sessions.Ledger((3, 2, 2, 100))
    assert [led.admit("a", "d1", "c1", 40, 0, 10), led.admit("a", "d1", "c1", 40, 1, 10), led.admit("b", "d1", "c2", 40, 1, 10), led.admit("c", "d1", "c3", 1, 1, 10), led.admit("e", "d2", "c1", 40, 1, 10), led.admit("f", "d2", "c1", 5, 1, 10), led.admit("g", "d3", "c3", 5, 2, 10), led.admit("g", "d3", "c1", 5, 20, 10)] == [1, 2, 1, 4, 6, 1, 3, 1]
    ev = lambda *x: [dict(zip(("kind", "number", "digest"), e, strict=True)) for e in x]
    s, codes = sessions.fold_session(ev(("create", 3, ""), ("chunk", 2, "x"), ("complete", 0, ""), ("chunk", 0, "y"), ("chunk", 0, "y"), ("chunk", 0, "z"), ("chunk", 1, "w"), ("complete", 0, ""), ("complete", 0, ""), ("verified", 0, "bad"), ("chunk", 1, "w"), ("complete", 0, "")))
    assert codes == [1, 0, 4, 0, 1, 2, 0, 0, 1, 1, 3, 3] and (s.state, s.failure) == ("FAILED", "FILE_INTEGRITY_MISMATCH")
    assert sessions.fold_session(ev(("chunk", 0, "a"), ("complete", 0, "")))[1] == [4, 5]


def test_collector_rules(spark):
    assert sessions.next_task_state("UPLOADING", "OK") == "COMPLETING" and sessions.next_task_state("COMPLETING", "SESSION_MISSING") == "READY" and sessions.next_task_state("READY", "FAIL") == "FAILED" and sessions.next_task_state("READY", "RETRY") == "READY"
    names = spark.createDataFrame([(n,) for n in (".x", "a.meta.json", "a.done", "a.tmp", "a.part", "a.csv")], "name string")
    assert [r[0] for r in source.device_inputs(names).collect()] == ["a.csv"]
    side = '{"work_order":null,"product_sn":"P","file_type":"TEST_REPORT","result":"PASS","produced_at":"2026-07-11T08:00:00.123Z"}'
    rows = spark.createDataFrame([(side,), (side[:-1] + ',"x":1}',), (side.replace('"P"', "5"),), (side.replace(".123", ""),), ("{",)], "json string").withColumn("file_size", F.lit(2_300_000))
    got = source.sidecars(rows).collect()
    assert [r["sidecar_ok"] for r in got] == [True, False, False, False, False] and got[0]["chunk_count"] == 3
    assert [source.safe_path(p) for p in ("a/b", "/a", "", "a//b", "a/../b", "./a")] == [True] + [False] * 5
    part = "0" * 8 + "-0000" * 3 + "-" + "0" * 12
    files = spark.createDataFrame([(part + ".part", 1), (part.upper().replace("0", "A") + ".part", 1), (part[:-1] + "1.part", 1), (part[:-1] + "2.part", 99)], "name string, mtime_s long")
    live = spark.createDataFrame([(part[:-1] + "1", "UPLOADING")], "session string, state string")
    assert [r["name"] for r in sessions.cleanup(files, live, 50).collect()] == [part + ".part"]


def test_authentication(spark):
    devices = spark.createDataFrame([("D1", True, bytearray(b"k")), ("D2", False, bytearray(b"k"))], "device_id string, enabled boolean, hmac_secret binary")
    r = spark.createDataFrame([("D1", 1000, "r1", "s"), ("D1", 1, "r2", "s"), ("D2", 1000, "r3", "s"), ("D3", 1000, "r4", "s"), (None, 1000, "r5", "s"), ("D1", 1000, "r6", "s")], "device_id string, ts_s long, request_id string, body_sha256 string").withColumns({"method": F.lit("GET"), "path": F.lit("/x")})
    good = hmac_sha256(F.lit("k").cast("binary"), canonical_request(F.col("method"), F.col("path"), F.col("device_id"), F.col("ts_s").cast("string"), F.col("request_id"), F.col("body_sha256")))
    r = r.withColumn("signature", F.when(F.col("request_id") == "r6", "bad").otherwise(F.coalesce(good, F.lit(""))))
    got = {x["request_id"]: x["auth_code"] for x in service.authenticate(r, devices, 1100).collect()}
    assert got == {"r1": "OK", "r2": "TIMESTAMP_EXPIRED", "r3": "DEVICE_DISABLED", "r4": "DEVICE_NOT_FOUND", "r5": "AUTH_REQUIRED", "r6": "SIGNATURE_INVALID"}
    assert service.token_ok("Bearer t", "t") and not service.token_ok(None, "t")
    assert service.envelope(spark.range(1), "q").first()["reply"] == '{"code":"OK","message":"ok","request_id":"q","data":{"id":0}}'
    assert service.healthy({"a": True, "b": False}) == (False, '{"a": "up", "b": "down"}')
    assert len(service.ARCHIVE_STATUS) == 26 and len(service.SEARCH_STATUS) == 11


def test_streams(spark, tmp_path):
    rows = [("s1", 0, "create", 2, ""), ("s1", 1, "chunk", 0, "a"), ("s2", 0, "chunk", 0, "a")]
    schema = "session string, seq long, kind string, number long, digest string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c1"))
    spark.createDataFrame([("s1", 2, "chunk", 1, "b"), ("s1", 3, "complete", 0, "")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c1"))
    got = sorted((r["session"], r["seq"], r["code"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s1", 0, 1), ("s1", 1, 0), ("s1", 2, 0), ("s1", 3, 0), ("s2", 0, 4)]
    t = [("d", "r", dt.datetime(2026, 1, 1, 0, 0, s)) for s in (0, 1, 2)]
    spark.createDataFrame(t, "device_id string, request_id string, ts timestamp").write.parquet(str(tmp_path / "rq"))
    s = spark.readStream.schema("device_id string, request_id string, ts timestamp").parquet(str(tmp_path / "rq"))
    jobs.run_once(jobs.without_replays(s), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "rq-out")), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "rq-out")).count() == 1
