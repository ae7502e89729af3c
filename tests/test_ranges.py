"""Lines by byte ranges against a plain split of the same bytes, whatever the ranges."""

import hashlib
import random

import pytest

from tracewright.sources import files as source

BODIES = {
    "a/plain.log": b"one\ntwo\r\n\nfour\r\r\nfive",
    "a/end.log": b"x\n" * 9,
    "b/sp ace+%41[1].log": b"\xff\xfe\n\r\n\xc3\xa9\n",
    "b/long.log": b"q" * 700 + b"\n" + b"r" * 300,
    "empty.log": b"",
    "lf.log": b"\n",
    "mark.log": b"\xef\xbb\xbfa,b\nc\n",
    "open-mark.log": b"\xef\xbb\xbfa\n\xef\xbb\xbfb",
    "only-mark.log": b"\xef\xbb\xbf",
    "bytes.log": bytes(random.Random(4).choice(b"ab\n\n\r\x00\x80") for _ in range(500)),
}


def expected(body):
    parts = body.split(b"\n")
    out, at = [], 0
    for n, line in enumerate(parts[:-1] if parts[-1] == b"" else parts, 1):
        bare = line.removesuffix(b"\r")
        out.append((n, at, len(bare), bare.decode("latin-1")))
        at += len(line) + 1
    return out


@pytest.fixture
def archive(spark, tmp_path):
    for name, body in BODIES.items():
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return source.Archive(spark, f"file://{tmp_path}/files")


@pytest.mark.parametrize("split", [1, 2, 7, 100, 1 << 20])
def test_any_split(spark, archive, tmp_path, split):
    names = [n for n in BODIES if split > 6 or "log" in n and "long" not in n and "bytes" not in n]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = archive.scan([*names, "../up", "no/such"], f"file://{tmp_path}/scan")
        ranges = scan.source.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in scan.lines().collect():
        got.setdefault(r["relative_path"], []).append((r["line_no"], r["byte_offset"], r["byte_length"], r["raw"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: expected(b) for k, b in BODIES.items() if b and k in names}
    assert {r["relative_path"]: (r["length"], r["sha256"]) for r in scan.digests().collect()} == {k: (len(b), hashlib.sha256(b).hexdigest()) for k, b in BODIES.items() if k in names}
    assert split > 100 or ranges > len(names)


def test_digests_alone_keep_no_lines_of_whole_files(spark, archive, tmp_path):
    scan = archive.scan(list(BODIES), f"file://{tmp_path}/scan", keep_raw=False)
    assert scan.stored.where("i IS NOT NULL").count() == 0 and scan.digests().where("sha256 IS NULL").count() == 0
    assert archive.scan([], f"file://{tmp_path}/none").lines().count() == 0


def test_one_record_reads_its_bytes(spark, archive):
    body = BODIES["bytes.log"]
    assert archive.record("bytes.log", 500, 100, 37) == body[100:137] and archive.record("bytes.log", 500, 500, 0) == b""
    for bad in (("bytes.log", 499, 0, 1), ("bytes.log", 500, 400, 101), ("bytes.log", 500, -1, 1), ("../x", 500, 0, 1), ("no", 500, 0, 1)):
        assert archive.record(*bad) is None
    row = source.read_record(archive, "bytes.log", 500, 0, 5).first()
    assert bytes(row["raw"]) == body[:5] and row["failure"] is None
    assert source.read_record(archive, "bytes.log", 1, 0, 5).first()["failure"] == "STORAGE_IO_ERROR"
