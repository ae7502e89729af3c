"""What an index does over its life: writers apart, late archives, merged segments, damaged files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import search
from tracewright.plans import log_index
from tracewright.plans.log_index import DamagedSegment, LogIndex, WriterBusy
from tracewright.sources import archives as source
from tracewright.sources.commit_log import CommitLog, Conflict
from tracewright.sources.files import Archive


def line(i, n):
    level = "ERROR" if (i + n) % 3 == 0 else "INFO"
    return f"2031-02-03T04:{i % 60:02d}:{n % 60:02d}.000Z level={level} module=m{n % 2} device=D code={'E1' if level == 'ERROR' else '-'} note=word{i % 4} more=w{n}\n"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Nine log files, the last without a profile."""
    root = tmp_path_factory.mktemp("files")
    rows = []
    for i in range(1, 10):
        body = "".join(line(i, n) for n in range(4)).encode()
        (root / f"{i}.log").write_bytes(body)
        rows.append((i, "L", "S", "D" if i < 9 else "X", "C", None, None, "RUNTIME_LOG", "f", f"{i}.log", len(body), hashlib.sha256(body).hexdigest()))
    table = spark.createDataFrame(rows, "archive_id long, line_id string, station_id string, device_id string, collector_id string, work_order string, product_sn string, file_type string, original_filename string, relative_path string, file_size long, file_sha256 string")
    table = table.withColumns({"archived_at": F.lit("2031-02-03").cast("timestamp"), "produced_at": F.lit("2031-02-03").cast("timestamp")})
    return table, Archive(spark, f"file://{root}"), spark.createDataFrame([("D", "RUNTIME_LOG", "kv_runtime_v1")], "device_id string, file_type string, profile_name string")


def found(x, words=("word1",)):
    page = x.engine().search(search.SearchQuery(list(words), page_size=50), guarded=False)
    return page.total_hits, [(r["archive_id"], r["line_no"], r["score"]) for r in page.items.collect()]


def test_put_if_absent(spark, tmp_path):
    log, other = CommitLog(spark, f"file://{tmp_path}/log"), CommitLog(spark, f"file://{tmp_path}/log")
    assert log.newest() == (0, {}) and log.versions() == []
    log.put(1, {"a": "é"})
    with pytest.raises(Conflict):
        other.put(1, {"a": 2})
    other.put(2, {"b": []})
    assert log.newest() == (2, {"b": []}) and log.read(1) == {"a": "é"} and log.versions() == [1, 2]
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")) == ["000000000001.json", "000000000002.json"]


def test_two_writers_and_a_stale_lock(spark, world, tmp_path):
    """Both hold the lock to be theirs; the log lets one go on, and the other can begin anew."""
    table, files, profiles = world
    a, b = LogIndex(spark, f"file://{tmp_path}", lease_s=-60), LogIndex(spark, f"file://{tmp_path}", lease_s=-60)
    with a._writer(), b._writer():
        assert b.scan_once(table.where("archive_id <= 2"), files, profiles)["batch_id"] == 1
        with pytest.raises(WriterBusy):
            a.scan_once(table.where("archive_id <= 2"), files, profiles)
        assert b.build_next(files) == 1
    assert not (tmp_path / ".writer.lock").exists() and a.head() == b.head()
    assert a.scan_once(table.where("archive_id <= 3"), files, profiles)["batch_id"] == 2 and a.tables()[0].count() == 2


def test_late_archives_by_offsets(spark):
    """Any order of arrival: each id once, and nothing twice, by ranges of missing ids."""
    rng = random.Random(7)
    ids = [i for i in range(1, 400) if rng.random() < 0.8] + [10_000, 10_001, 5_000_000]
    kinds = {i: rng.choice(["RUNTIME_LOG", "TEST_REPORT", "NG_IMAGE"]) for i in ids}
    late = set(rng.sample(ids[:-3], 40))
    frame = lambda some: spark.createDataFrame([(i, kinds[i]) for i in some], "archive_id long, file_type string")
    high, gaps, got = 0, [], []
    for there in ([i for i in ids if i not in late and i < 5000], [i for i in ids if i < 5000], ids):
        while True:
            some, high, gaps = source.discover(frame(there), high, gaps, 25)
            got += some
            if not some:
                break
    want = [i for i in ids if kinds[i] != "NG_IMAGE"]
    assert sorted(got) == want and len(got) == len(set(got))
    assert len(gaps) <= source.MAX_GAPS and all(b > high - source.LATE_SPAN for _, b in gaps)


def test_discovery_reads_what_it_finds(spark, tmp_path):
    """A call late in the life of a table of many ids reads few row groups."""
    spark.range(1, 200_001).select(F.col("id").alias("archive_id"), F.lit("RUNTIME_LOG").alias("file_type")).repartitionByRange(40, "archive_id").sortWithinPartitions("archive_id").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    read, real = [], type(table).collect

    def counted(df):
        rows = real(df)
        leaf = df._jdf.queryExecution().executedPlan()
        text = leaf.toString()
        if "archive_id" in text:
            read.append(sum(leaf2.metrics().apply("numOutputRows").value() for leaf2 in _scans(leaf)))
        return rows

    def _scans(plan):
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        leaves = plan.collectLeaves()
        return [leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName()]

    for high in (1_000, 100_000, 199_000):
        read.clear()
        type(table).collect = counted
        try:
            ids, _, _ = source.discover(table, high, [[high - 10, high - 8]], 100)
        finally:
            type(table).collect = real
        assert ids[0] == high - 10 and len(ids) == 100 and sum(read) <= 2 * 5_000 + 5_000


def test_offsets_given_up_are_found_by_a_rescan(spark, world, tmp_path, monkeypatch):
    table, files, profiles = world
    monkeypatch.setattr(source.discover, "__defaults__", (0,))
    x = LogIndex(spark, f"file://{tmp_path}")
    assert x.scan_once(table.where("archive_id IN (1, 4)"), files, profiles)["source_files"] == 2 and x.head()["gaps"] == []
    early = table.where("archive_id <= 4")
    assert x.scan_once(early, files, profiles)["batch_id"] is None and x.rescan(early) == 2
    assert x.scan_once(early, files, profiles)["source_files"] == 2 and x.rescan(early) == 0 and x.tables()[1].count() == 4


def test_what_a_batch_has_no_room_for_comes_next(spark, world, tmp_path):
    table, files, profiles = world
    x = LogIndex(spark, f"file://{tmp_path}")
    first = x.scan_once(table, files, profiles, max_documents=9)
    assert first["source_files"] == 2 and x.head()["pending"] == [3, 4, 5, 6, 7, 8, 9]
    assert x.scan_once(table, files, profiles)["source_files"] == 7 and x.head()["pending"] == [] and x.tables()[1].count() == 9


def test_merged_segments(spark, world, tmp_path):
    """Search is the same before, during and after merges; segments stay few; a rebuilt batch leaves its merged segment; old ones go."""
    table, files, profiles = world
    x = LogIndex(spark, f"file://{tmp_path}")
    for i in range(1, 10, 2):
        x.scan_once(table.where(F.col("archive_id") <= i + 1), files, profiles)
        x.build_next(files)
    before, old = found(x), x.engine()
    assert len(x.head()["segments"]) == 4 and before[0] == 8 and x.tables()[0].where("state = 'READY'").count() == 4
    assert x.compact(fanout=2, grace_s=3600) == 3
    h = x.head()
    assert len(h["segments"]) == 1 and h["segments"][0]["batches"] == [[1, 4]] and len(h["retired"]) == 6
    assert found(x) == before and old.hits(search.SearchQuery(["word1"])).count() == before[0]
    assert x.verify(3) and x.audit().isEmpty() and x.orphans() == [] and x.engine().version == 4
    name = h["segments"][0]["name"]
    t = {n: log_index.index.load(spark, x.root, n, [name]) for n in log_index.index.TABLES}
    assert log_index.index.violations(t["documents"], t["files"], t["postings"], t["terms"], t["stats"], merged=True).isEmpty() and t["stats"].count() == 1
    d = x.engine().detail((3 << 32) + 1, x.files(), files).first()
    assert d["raw"].decode() == line(d["archive_id"], d["line_no"] - 1).rstrip("\n")
    assert x.compact(fanout=2, grace_s=-1) == 0 and x.head()["retired"] == []
    assert sorted(p.name for p in (tmp_path / "postings").iterdir()) == [name] == [p.stem for p in (tmp_path / "segments").iterdir() if p.suffix == ".json"]
    assert x.rebuild(5)
    gone = found(x)
    assert gone[0] < before[0] and all(a not in (5, 6) for a, _, _ in gone[1]) and x.head()["segments"][0]["batches"] == [[1, 2], [4, 4]]
    assert x.run(lambda: table, files, lambda: profiles, cycles=1) == 1
    again = found(x)
    assert again[0] == before[0] and sorted((a, n, round(s, 9)) for a, n, s in again[1]) == sorted((a, n, round(s, 9)) for a, n, s in before[1])


def test_damaged_segments_are_refused(spark, world, tmp_path):
    table, files, profiles = world
    x = LogIndex(spark, f"file://{tmp_path}")
    x.scan_once(table, files, profiles)
    x.build_next(files)
    part = next(p for p in (tmp_path / "postings/batch_id=1").iterdir() if p.suffix == ".parquet")
    whole = part.read_bytes()
    part.write_bytes(whole[:100] + bytes([whole[100] ^ 1]) + whole[101:])
    (part.parent / f".{part.name}.crc").unlink()
    x.engine()
    with pytest.raises(DamagedSegment, match=part.name):
        x.engine(digests=True)
    assert [(r["file"], r["problem"]) for r in x.audit().collect()] == [(f"postings/batch_id=1/{part.name}", "sha256")] and not x.verify(1)
    part.write_bytes(whole[:-5])
    with pytest.raises(DamagedSegment, match=part.name):
        x.engine()
    part.unlink()
    assert [r["problem"] for r in x.audit().collect()] == ["missing"]
    (tmp_path / "segments/batch_id=1.json").write_text("{}")
    (tmp_path / "segments/.batch_id=1.json.crc").unlink(missing_ok=True)
    with pytest.raises(DamagedSegment, match="manifest"):
        x.engine()
