"""Five archives from bytes to pages: parsing, failures, index, search and rebuild, against a plain model of the same files."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import schemas
from tracewright.operators import index, parsers, search, state
from tracewright.plans.log_index import LogIndex, WriterBusy
from tracewright.sources import files as source
from tracewright.sources.archives import decode_guard

RUN, REPORT = "RUNTIME_LOG", "TEST_REPORT"
REPORT_HEAD = "TestPoint,TestName,LowerLimit,UpperLimit,Measured,Unit,Result"
#: archive, device, kind, bytes; the last but one has no profile, the last a wrong hash.
FILES = [
    (11, "PRESS-7", RUN, b"2031-02-03T04:05:06.007Z level=INFO module=hydraulics device=PRESS-7 code=- note=idle\n2031-02-03T04:05:09.250Z level=ERROR module=hydraulics device=PRESS-7 code=OIL_HOT note=idle note2=stop\n"),
    (12, "OVEN-2", RUN, b"2031-02-03T05:00:00.000Z level=WARN module=zone3 device=OVEN-2 code=DRIFT event=ramp\r\n2031-02-03T05:10:00.000Z level=INFO module=zone3 device=OVEN-2 code=- event=idle\r\n2031-02-03T05:20:00.000Z level=INFO module=zone1 device=OVEN-2 event=idle\r\n"),
    (13, "SCALE-9", REPORT, ("\ufeffReportVersion,1.2\nDeviceId,SCALE-9\nWorkOrder,JOB-5\nProductSN,KX-77\nTestedAt,2031-02-03T06:30:00.000Z\nOverallResult,NG\n" + REPORT_HEAD + "\nW1,tare,-1,1,0.25,gram,PASS\nW2,\"full, shaken\",99,101,104.5,gram,NG\n").encode()),
    (14, "LOST-1", RUN, b"2031-02-03T07:00:00.000Z level=ERROR module=none code=X\n"),
    (15, "OVEN-2", RUN, b"2031-02-03T08:00:00.000Z level=ERROR module=zone2 code=Y\n"),
]
PROFILES = [("PRESS-7", RUN, "kv_runtime_v1"), ("OVEN-2", RUN, "kv_runtime_v1"), ("SCALE-9", REPORT, "fct_csv_v1")]


def model():
    """(archive, line, offset, length, tokens) of the documents, in order."""
    out = []
    for i, _, kind, data in FILES[:3]:
        at = 0
        for n, line in enumerate(data.split(b"\n")[:-1], 1):
            bare = line.removesuffix(b"\r")
            if kind == RUN or n > 7:
                text = bare.decode().translate({c: c + 32 for c in range(65, 91)})
                out.append((i, n, at, len(bare), [w for w in re.split(r"[^a-z0-9_\-\x80-\U0010ffff]+", text) if w]))
            at += len(line) + 1
    return out


def scores(terms):
    """Local id to BM25 of the documents with all terms."""
    docs = [d[4] for d in model()]
    mean = sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in terms}
    part = lambda d, t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return {i: sum(part(d, t) for t in terms) for i, d in enumerate(docs) if all(t in d for t in terms)}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    rows = []
    for i, device, kind, data in FILES:
        path = f"2031/02/03/{device}/{i}.{'csv' if kind == REPORT else 'log'}"
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
        sha = "0" * 64 if i == 15 else hashlib.sha256(data).hexdigest()
        rows.append((i, "HALL-1", f"CELL-{i}", device, "BOX-1", "JOB-5" if i == 13 else None, None, kind, "f", path, len(data), sha, "2031-02-03 09:00:00", "2031-02-03 09:01:00"))
    table = spark.createDataFrame(rows, "archive_id long, line_id string, station_id string, device_id string, collector_id string, work_order string, product_sn string, file_type string, original_filename string, relative_path string, file_size long, file_sha256 string, produced_at string, archived_at string")
    table = table.withColumns({"archived_at": F.to_timestamp("archived_at"), "produced_at": F.to_timestamp("produced_at")})
    profiles = spark.createDataFrame(PROFILES, "device_id string, file_type string, profile_name string")
    files = source.Archive(spark, f"file://{root}")
    docs, outcomes = parsers.parse_archives(decode_guard(table), source.read_files(spark, f"file://{root}"), profiles)
    return table, profiles, files, docs.cache(), outcomes.cache()


@pytest.fixture(scope="module")
def engine(spark, archive, tmp_path_factory):
    _, _, _, docs, outcomes = archive
    root = f"file://{tmp_path_factory.mktemp('index')}"
    index.build_segment(docs, outcomes, 1, root)
    t = {n: index.load(spark, root, n, [1]) for n in index.TABLES}
    return search.SearchEngine(t["documents"], t["postings"], t["stats"], t["terms"], [1]), t


def test_outcomes(archive):
    got = {r["archive_id"]: (r["failure_code"], r["document_count"]) for r in archive[4].collect()}
    assert got == {11: (None, 2), 12: (None, 3), 13: (None, 2), 14: ("PARSER_PROFILE_NOT_FOUND", 0), 15: ("ARCHIVE_SHA256_MISMATCH", 0)}
    assert parsers.batch_summary(archive[4]).first().asDict() == {"source_files": 5, "parsed_files": 3, "failed_files": 2, "documents": 7}


def test_documents(engine):
    rows = engine[1]["documents"].orderBy("local_id").collect()
    got = [(r["archive_id"], r["line_no"], r["byte_offset"], r["byte_length"], r["term_count"]) for r in rows]
    assert got == [(*d[:4], len(d[4])) for d in model()]
    assert all(r["doc_id"] == (1 << 32) + i == (1 << 32) + r["local_id"] for i, r in enumerate(rows))
    assert rows[6]["event_name"] == "W2:full, shaken" and rows[6]["error_code"] == "FCT_LIMIT_FAIL" and rows[6]["product_sn"] == "KX-77" and rows[0]["error_code"] == ""


def test_index(engine):
    t = engine[1]
    docs = [d[4] for d in model()]
    assert t["terms"].count() == len({w for d in docs for w in d}) and t["postings"].count() == sum(len(set(d)) for d in docs)
    check = lambda posts, terms=t["terms"], stats=t["stats"]: {r["rule"] for r in index.violations(t["documents"], t["files"], posts, terms, stats).collect()}
    assert check(t["postings"]) == set()
    assert check(t["postings"].withColumn("tf", F.col("tf") - 1)) == {"term_frequency", "length_differs"}
    assert check(t["postings"], t["terms"].withColumn("posting_begin", F.lit(0).cast("long"))) == {"postings_not_contiguous", "repeated_begin"}
    assert check(t["postings"], stats=t["stats"].withColumn("average_length", F.lit(3.0))) == {"statistics_differ"}


@pytest.mark.parametrize("words", [["oil_hot"], ["idle"], ["idle", "zone3"], ["gram", "pass"], ["absent"], ["idle", "absent"]])
def test_bm25(engine, words):
    got = {r["doc_id"] & 0xFFFFFFFF: r["bm25"] for r in engine[0].hits(search.SearchQuery(words)).collect()}
    assert got == pytest.approx(scores(words), abs=1e-12)


def test_search_and_detail(engine, archive, spark):
    e, t = engine
    page = e.search(search.SearchQuery(["IDLE", "hydraulics"], device_id="PRESS-7", page_size=10))
    rows = search.summary(page.items).collect()
    assert page.total_hits == 2 and page.snapshot_version == 1 and rows[0]["error_code"] == "OIL_HOT" and rows[0]["occurred_at"] == "2031-02-03T04:05:09.250Z" and rows[1]["error_code"] is None
    assert e.anomalies(search.SearchQuery(device_id="PRESS-7")).total_hits == 1
    weight = {1: 2.0, 2: 1.0, 6: 2.0}
    ranked = [(r["local_id"], r["score"]) for r in e.search(search.SearchQuery(["idle"]), guarded=False).items.collect()]
    want = sorted(((s + weight.get(i, 0.0), i) for i, s in scores(["idle"]).items()), reverse=True)
    assert [i for i, _ in ranked] == [i for _, i in want] and [s for _, s in ranked] == pytest.approx([s for s, _ in want])
    d = e.detail((1 << 32) + 1, t["files"], archive[2])
    shown = search.detail_fields(d).first()
    assert shown["raw"] == FILES[0][3].decode().split("\n")[1] and shown["score"] == 0.0 and shown["archive_id"] == 11 and d.first()["failure"] is None
    assert e.detail(99, t["files"], archive[2]).count() == 0
    assert source.read_record(archive[2], d.first()["relative_path"], 1, 0, 1).first()["failure"] == "STORAGE_IO_ERROR"
    assert [r["local_id"] for r in e.restore(1, [(1 << 32) + 3, (1 << 32) + 1]).collect()] == [3, 1]
    with pytest.raises(search.InvalidQuery):
        e.restore(2, [])
    catalog = spark.createDataFrame([("OIL_HOT", True), ("OFF", False)], "error_code string, enabled boolean")
    row, best = e.error_code("OIL_HOT", catalog)
    assert row.count() == 1 and best.items.first()["score"] == 5.0
    for code in ("OFF", "NEW"):
        with pytest.raises(LookupError):
            e.error_code(code, catalog)


def test_only_the_wanted_file_is_opened(archive):
    path = archive[0].where("archive_id = 12").first()["relative_path"]
    rows = archive[2].files([path, "../x", "no/such"])
    assert rows.count() == 1 and len(rows.inputFiles()) == 1 and archive[2].files([]).count() == 0


def test_batch_reads_and_parses_once(spark, archive, tmp_path, monkeypatch):
    """One scan of the files, of bytes alone; what is stored between the steps is read by the next."""
    plans = []
    whole = source.Archive.scan

    def kept(self, *args, **kwargs):
        scan = whole(self, *args, **kwargs)
        plans.append(scan.source._jdf.queryExecution().executedPlan().toString())
        return scan

    monkeypatch.setattr(source.Archive, "scan", kept)
    monkeypatch.setattr(source.Archive, "files", lambda *_: pytest.fail("no file is read as one row"))
    table, profiles, files, docs, outcomes = archive
    x = LogIndex(spark, f"file://{tmp_path}")
    s = x.scan_once(table, files, profiles)
    assert len(plans) == 1 and plans[0].count("Scan text") == 1 and "binaryFile" not in plans[0]
    checked, out = (spark.read.parquet(f"{x.root}/{t}/batch_id=1") for t in ("parsed", "outcomes"))
    assert s == {"source_files": 5, "parsed_files": 3, "failed_files": 2, "documents": 7, "batch_id": 1} and not (tmp_path / "scan/batch_id=1").exists()
    columns = sorted(docs.columns)
    assert sorted(map(repr, parsers.documents_of(checked, out).select(columns).collect())) == sorted(map(repr, docs.select(columns).collect()))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, outcomes.collect()), key=repr)


def parse(spark, body, kind=RUN, **archive):
    """Failure code and line of one file."""
    row = {"archive_id": 1, "line_id": "L", "station_id": "S1", "device_id": "D1", "collector_id": "C", "work_order": None, "product_sn": None, "file_type": kind, "relative_path": "a/b", "file_size": len(body), "file_sha256": hashlib.sha256(body).hexdigest()} | archive
    types = {"archive_id": "long", "file_size": "long"}
    a = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in row)).withColumn("archived_at", F.lit("2026-01-01").cast("timestamp"))
    profile = spark.createDataFrame([("D1", RUN, "kv_runtime_v1"), ("D1", REPORT, "fct_csv_v1"), ("D2", RUN, "other")], "device_id string, file_type string, profile_name string")
    f = spark.createDataFrame([("a/b", bytearray(body))], "relative_path string, content binary").withColumns({"length": F.octet_length("content"), "sha256": F.sha2("content", 256)})
    r = parsers.parse_archives(a, f, profile, 200)[1].first()
    return r["failure_code"], r["failure_line"]


T = b"2031-02-03T08:00:00.000Z "


@pytest.mark.parametrize("body,expected", [
    (T + b"level=INFO module=m\n", (None, None)), (T + b"level=INFO module=m \n", (None, None)), (T + b"level=INFO  module=m\n", ("RUNTIME_LOG_FORMAT_INVALID", 1)), (T + b"level=INFO module=m a=b=c\n", ("RUNTIME_LOG_FORMAT_INVALID", 1)),
    (T + b"level=INFO module=m level=INFO", ("RUNTIME_LOG_FORMAT_INVALID", 1)), (T + b"level=INFO", ("RUNTIME_LOG_FORMAT_INVALID", 1)), (T + b"level=BAD module=m", ("RUNTIME_LOG_FORMAT_INVALID", 1)), (T + b"level=INFO module=m device=D9", ("RUNTIME_LOG_METADATA_MISMATCH", 1)),
    (T + b"level=INFO module=m\n\n", ("RUNTIME_LOG_FORMAT_INVALID", 2)), (b"x level=INFO module=m", ("RUNTIME_LOG_TIME_INVALID", 1)), (T + b"level=INFO module=\xc0\xaf", ("INVALID_UTF8", 1)), (T + b"level=INFO module=" + b"m" * 300, ("LINE_TOO_LONG", 1)), (b"", ("RUNTIME_LOG_EMPTY", None)),
])
def test_runtime_log(spark, body, expected):
    assert parse(spark, body) == expected


def test_file_failures(spark):
    good = T + b"level=INFO module=m\n"
    assert parse(spark, good, file_size=1)[0] == "ARCHIVE_SIZE_MISMATCH"
    assert parse(spark, good, file_sha256="0" * 64)[0] == "ARCHIVE_SHA256_MISMATCH"
    assert parse(spark, good, relative_path="../b")[0] == "ARCHIVE_PATH_INVALID"
    assert parse(spark, good, relative_path="a/c")[0] == "ARCHIVE_FILE_NOT_FOUND"
    assert parse(spark, good, device_id="D2")[0] == "PARSER_PROFILE_UNSUPPORTED"
    assert parse(spark, good, device_id="D3")[0] == "PARSER_PROFILE_NOT_FOUND"


HEAD = b"ReportVersion,1.2\nDeviceId,D1\nWorkOrder,W\nProductSN,P\nTestedAt,2031-02-03T08:00:00.000Z\nOverallResult,PASS\nTestPoint,TestName,LowerLimit,UpperLimit,Measured,Unit,Result\n"


@pytest.mark.parametrize("body,expected", [
    (HEAD + b"a,b,1,2,9,u,PASS\n", (None, None)), (HEAD, ("FCT_CSV_EMPTY", None)), (HEAD + b"a,b,3,2,1,u,PASS", ("FCT_CSV_ROW_INVALID", 8)), (HEAD + b'"a,b,1,2,9,u,PASS', ("FCT_CSV_FORMAT_INVALID", 8)), (HEAD + b'"a"x,b,1,2,9,u,PASS', ("FCT_CSV_FORMAT_INVALID", 8)),
    (HEAD.replace(b"DeviceId,D1", b"DeviceId,D9"), ("FCT_CSV_METADATA_MISMATCH", 6)), (HEAD.replace(b"1.2", b"1.3") + b"a,b,1,2,9,u,NG", ("FCT_CSV_METADATA_MISMATCH", 6)), (HEAD.replace(b"WorkOrder", b"Order"), ("FCT_CSV_HEADER_INVALID", 3)), (HEAD.replace(b"Unit", b"U") + b"a,b,1,2,9,u,NG", ("FCT_CSV_HEADER_INVALID", 7)), (HEAD + b"a,b,1,nan,9,u,NG", ("FCT_CSV_ROW_INVALID", 8)),
])
def test_report(spark, body, expected):
    assert parse(spark, body, REPORT) == expected


def test_batch_limits(spark):
    o = spark.createDataFrame([(1, 5), (2, 90), (3, 4), (4, 3)], "archive_id long, document_count long").withColumn("failure_code", F.lit(None).cast("string"))
    got = [(r["archive_id"], r["document_count"], r["failure_code"]) for r in parsers.cut_batch(o, 10).orderBy("archive_id").collect()]
    assert got == [(1, 5, None), (2, 0, "DOCUMENT_LIMIT_EXCEEDED"), (3, 4, None)]


def test_batch_cutoff_by_ranges(spark):
    """The same cut as a running sum over all rows, without a window; ids are sparse, and counts may be 0 at the cut."""
    for step, most in ((1, 50), (9973, 777), (10**12, 10**9), (10**12, 0), (7, 3)):
        rows = [(i * step + 5, i % 5) for i in range(2000)]
        o = spark.createDataFrame(rows, "archive_id long, document_count long").withColumn("failure_code", F.lit(None).cast("string"))
        want, spent = [], 0
        for i, n in rows:
            n = 0 if n > most else n
            spent += n
            if spent <= most:
                want.append((i, n))
        got = parsers.cut_batch(o, most)
        assert sorted((r["archive_id"], r["document_count"]) for r in got.collect()) == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_batch_cutoff_reads_all_orders(spark):
    from helpers import SF

    from tracewright.plans import catalogue

    assert "<= 1000" not in catalogue.batch_cutoff(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_state_machine(spark, archive):
    batches = spark.createDataFrame([(1, "PARSING", None)], "batch_id long, state string, failure_code string")
    indexed = state.attach(spark.createDataFrame([], "archive_id long, batch_id long, state string, document_count long, failure_code string"), archive[0], 1)
    indexed = state.apply_outcomes(indexed, archive[4])
    for a, b in (("PARSING", "PARSED"), ("PARSED", "BUILDING")):
        batches, moved = state.move_batch(batches, 1, a, b)
        assert moved
    assert not state.move_batch(batches, 1, "PARSED", "BUILDING")[1]
    batches, indexed = state.publish_ready(batches, indexed, 1)
    assert {r["state"]: r["count"] for r in state.state_counts(indexed).collect()} == {"INDEXED": 3, "FAILED": 2} and state.ready_list(batches) == [1]
    b2, i2 = state.request_rebuild(batches, indexed, 11)
    assert b2.first()["failure_code"] == "REBUILD_REQUESTED" and {r["state"] for r in i2.collect()} == {"PENDING"}
    r = spark.createDataFrame([(1, "PARSING", None), (2, "BUILDING", None), (3, "BUILDING", None), (4, "BUILDING", None), (5, "READY", None)], "batch_id long, state string, failure_code string")
    got = {x["batch_id"]: (x["state"], x["failure_code"]) for x in state.recover(r, [3, 4], [3]).collect()}
    assert got == {1: ("FAILED", "BATCH_INTERRUPTED"), 2: ("PARSED", None), 3: ("READY", None), 4: ("FAILED", "SEGMENT_RECOVERY_CORRUPTED"), 5: ("READY", None)}


def test_log_index(spark, archive, tmp_path):
    """Scan, build, search, rebuild and build again, as a service would."""
    table, profiles, files, _, _ = archive
    x = LogIndex(spark, f"file://{tmp_path}")
    nothing = x.engine().search(search.SearchQuery(["idle"]), guarded=False)
    assert (nothing.total_hits, nothing.items.count(), x.engine().average) == (0, 0, 1.0)
    s = x.scan_once(table, files, profiles)
    assert s == {"source_files": 5, "parsed_files": 3, "failed_files": 2, "documents": 7, "batch_id": 1}
    assert x.scan_once(table, files, profiles)["batch_id"] is None
    assert x.build_next(files) == 1 and x.build_next(files) is None and x.verify(1) and not x.verify(2)
    assert x.engine().search(search.SearchQuery(["idle", "hydraulics"], device_id="PRESS-7")).total_hits == 2 and x.orphans() == []
    held = {r["archive_id"]: r for r in x.tables()[1].collect()}
    assert held[11]["indexed_at"] and held[11]["parser_profile"] == "kv_runtime_v1" and held[14]["indexed_at"] is None and held[14]["parser_profile"] is None
    assert x.rebuild(11) and not x.rebuild(99)
    assert x.engine().search(search.SearchQuery(["idle"]), guarded=False).total_hits == 0
    assert x.run(lambda: table, files, lambda: profiles, cycles=1) == 1
    batches, archives = x.tables()
    got = {r["batch_id"]: (r["state"], r["failure_code"], r["published_at"] is not None) for r in batches.collect()}
    assert got == {1: ("FAILED", "REBUILD_REQUESTED", True), 2: ("READY", None, True)}
    assert {r["state"]: r["count"] for r in state.state_counts(archives).collect()} == {"INDEXED": 3, "FAILED": 2}
    assert x.engine().version == 2 and x.engine().documents == 7


def test_recovery_and_lock(spark, archive, tmp_path, monkeypatch):
    """A crash in each step leaves a state that recover brings back; a second writer is turned away; old versions go."""
    from tracewright.plans import log_index

    monkeypatch.setattr(log_index, "COMPACT_AFTER", 3)
    table, profiles, files, _, _ = archive
    x = LogIndex(spark, f"file://{tmp_path}")
    states = lambda: {r["batch_id"]: (r["state"], r["failure_code"]) for r in x.tables()[0].collect()}

    def broken(*_):
        raise RuntimeError("power")

    with monkeypatch.context() as m:
        m.setattr(parsers, "parse_lines", broken)
        with pytest.raises(RuntimeError):
            x.scan_once(table, files, profiles)
    assert states() == {1: ("PARSING", None)}
    x.recover()
    assert states() == {1: ("FAILED", "BATCH_INTERRUPTED")} and x.scan_once(table, files, profiles)["batch_id"] == 2
    with monkeypatch.context() as m:
        m.setattr(index, "term_dictionary", broken)
        with pytest.raises(RuntimeError):
            x.build_next(files)
    assert states()[2][0] == "BUILDING"
    x.recover()
    assert states()[2] == ("PARSED", None)
    with monkeypatch.context() as m:
        m.setattr(LogIndex, "_publish", broken)
        with pytest.raises(RuntimeError):
            x.build_next(files)
    assert states()[2][0] == "BUILDING" and x.engine().documents == 0
    x.recover()
    assert states()[2] == ("READY", None) and x.engine().documents == 7 and x.verify(2)
    assert len(x._versions()) <= 10 and 1 <= sum(x._versions().values()) <= 3 and min(x._versions()) > 1
    assert len(list((tmp_path / "state").iterdir())) == len(x._versions())
    (tmp_path / ".writer.lock").write_text("")
    with pytest.raises(WriterBusy):
        x.rebuild(11)
    assert LogIndex(spark, x.root, lease_s=-60).rebuild(11) and x.engine().documents == 0
    (tmp_path / "parsed/batch_id=2").exists() or x.scan_once(table, files, profiles)
    b = max(states())
    spark.range(1).write.mode("overwrite").parquet(f"{x.root}/parsed/batch_id={b}")
    assert x.build_next(files) is None and states()[b] == ("FAILED", "SEGMENT_BUILD_FAILED")


def test_admin(spark, archive, tmp_path):
    from tracewright import admin

    table, profiles, files, _, _ = archive
    table.write.parquet(f"{tmp_path}/archives")
    profiles.write.parquet(f"{tmp_path}/profiles")
    root = f"file://{tmp_path}/index"
    scan = [root, "scan-once", "--archives", f"{tmp_path}/archives", "--files", files.root, "--profiles", f"{tmp_path}/profiles"]
    assert [admin.main(scan, spark), admin.main(scan, spark)] == [0, 1]
    assert [admin.main([root, "build-once", "--files", files.root], spark) for _ in range(2)] == [0, 1]
    assert [admin.main([root, *a], spark) for a in (["verify", "1"], ["recover"], ["rebuild", "11"], ["rebuild", "99"])] == [0, 0, 0, 1]
    with pytest.raises(SystemExit):
        admin.main([root, "rebuild"], spark)


def test_lines_of_a_long_file(spark):
    body = b"".join(b"%d\r\n" % i if i % 3 else b"\n" for i in range(30_000)) + b"end\r\r"
    got = source.lines(spark.createDataFrame([(bytearray(body),), (bytearray(b""),)], "content binary")).orderBy("line_no").collect()
    at, want = 0, []
    for i, line in enumerate(body.split(b"\n"), 1):
        want.append((i, at, len(line.removesuffix(b"\r"))))
        at += len(line) + 1
    assert [(r["line_no"], r["byte_offset"], r["byte_length"]) for r in got] == want


@pytest.mark.parametrize("line,fields", [("a,b", ["a", "b"]), ("", [""]), (",", ["", ""]), ('"a,""b""",c', ['a,"b"', "c"]), ('""', [""]), ('a"b,c', None), ('"a"b', None), ('"a', None), ('"a"",b', None), ('"' + '""' * 20000 + '"', ['"' * 20000]), ("x," * 20000, ["x"] * 20000 + [""])])
def test_csv_fields(spark, line, fields):
    assert spark.createDataFrame([(line,)], "s string").select(parsers.csv_fields(F.col("s")).alias("f")).first()["f"] == fields


def test_artifacts(spark, archive, tmp_path):
    from tracewright.operators import artifacts

    table, _, _, docs, outcomes = archive
    d = index.assign_ids(docs, 1).select(*[c.split()[0] for c in schemas.DOCUMENT.split(", ")])
    a = outcomes.where("failure_code IS NULL").select("archive_id", "file_size", "file_sha256", "relative_path", "document_count").join(table.select("archive_id", *artifacts.INHERITED), "archive_id")
    path = f"file://{tmp_path}/b1"
    artifacts.write(a, d, 1, path)
    assert artifacts.read(spark, path, 1)[1].count() == 7
    with pytest.raises(ValueError):
        artifacts.read(spark, path, 2)
    bad = {r["rule"] for r in artifacts.violations(a.union(a.limit(1)), d.where("local_id <> 2").withColumn("line_id", F.lit("X"))).collect()}
    assert bad == {"repeated_archive", "local_id_not_contiguous", "document_count_differs", "metadata_differs"}
