"""Publishing, spooling, backup and migrations on files."""

import hashlib

import pytest

from tracewright.sources import storage


def test_publish_and_spool(spark, tmp_path):
    root, data = f"file://{tmp_path}", b"payload"
    sha = hashlib.sha256(data).hexdigest()
    (tmp_path / "u.part").write_bytes(data)
    args = (spark, f"{root}/u.part", f"{root}/archive", "2031/a/b.log", len(data))
    assert [storage.publish(*args, s) for s in ("0" * 64, sha, sha)] == ["FILE_INTEGRITY_MISMATCH", "ARCHIVED", "ARCHIVED"]
    assert (tmp_path / "archive/2031/a/b.log").read_bytes() == data and not (tmp_path / "u.part").exists()
    assert storage.publish(spark, f"{root}/gone", f"{root}/archive", "x", 1, sha) == storage.publish(spark, f"{root}/gone", root, "../x", 1, sha) == "STORAGE_IO_ERROR"
    storage.save_task(spark, f"{root}/spool", {"task_id": "t", "state": "READY"})
    storage.save_task(spark, f"{root}/spool", {"task_id": "t", "state": "DONE"})
    assert (tmp_path / "spool/t.json").read_text() == '{"state": "DONE", "task_id": "t"}'
    assert storage.spool_bytes(spark, f"{root}/spool").first()["bytes"] == 33
    assert storage.spool_has_room(5, 5, 10, 6, 1) and not storage.spool_has_room(6, 5, 10, 6, 1) and not storage.spool_has_room(0, 5, 10, 5, 1)
    assert storage.above_low_water(100, 1000, 10, 50, 9) and not storage.above_low_water(100, 1000, 11, 50, 9) and not storage.above_low_water(59, 60, 10, 50, 1)
    bad = spark.createDataFrame([("2031/a/b.log", 7, sha), ("2031/a/c", 1, sha)], "relative_path string, file_size long, sha256 string")
    assert [tuple(r) for r in storage.verify_files(spark, f"{root}/archive", bad).collect()] == [("2031/a/c", "missing")]


def test_backup_and_migrations(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    storage.backup(spark, {"a": spark.range(9), "e": spark.range(0)}, path)
    assert {k: v.count() for k, v in storage.restore(spark, path).items()} == {"a": 9, "e": 0}
    with pytest.raises(Exception):
        storage.backup(spark, {"a": spark.range(1)}, path)
    spark.range(8).write.mode("overwrite").parquet(f"{path}/a")
    with pytest.raises(storage.StorageError):
        storage.restore(spark, path)
    scripts = {"001": "CREATE OR REPLACE TEMP VIEW m1 AS SELECT 1 AS x; CREATE OR REPLACE TEMP VIEW m2 AS SELECT x + 1 AS x FROM m1", "002": "CREATE OR REPLACE TEMP VIEW m3 AS SELECT x + 1 AS x FROM m2"}
    done = storage.migrate(spark, {}, {"001": scripts["001"]})
    assert storage.migrate(spark, done, scripts).keys() == {"001", "002"} and spark.table("m3").first()["x"] == 3
    with pytest.raises(storage.StorageError):
        storage.migrate(spark, done, {"001": "SELECT 2"})
