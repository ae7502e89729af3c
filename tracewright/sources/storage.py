"""File operations on any store that Hadoop reaches: publishing, spooling, capacity, backup and migrations."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files, safe_path

WINDOW_BYTES = 8 << 20


class StorageError(OSError):
    """STORAGE_IO_ERROR or STORAGE_CAPACITY_EXCEEDED."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def checked(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(length, sha256) of one file, None if there is none; read by one task, not by the driver."""
    p, fs = _fs(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return None
    r = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha")).first()
    return r["length"], r["sha"]


def publish(spark: SparkSession, temporary: str, root: str, relative: str, size: int, sha256: str) -> str:
    """ARCHIVED, FILE_INTEGRITY_MISMATCH or STORAGE_IO_ERROR. What is there already is verified and left; else the temporary file is verified and renamed, so a repeated call changes nothing."""
    if not safe_path(relative):
        return "STORAGE_IO_ERROR"
    final = f"{root.rstrip('/')}/{relative}"
    there = checked(spark, final)
    found = there or checked(spark, temporary)
    if found is None:
        return "STORAGE_IO_ERROR"
    if found != (size, sha256):
        return "FILE_INTEGRITY_MISMATCH"
    if there is None:
        target, fs = _fs(spark, final)
        fs.mkdirs(target.getParent())
        if not fs.rename(_fs(spark, temporary)[0], target):
            return "STORAGE_IO_ERROR"
    return "ARCHIVED"


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small file that appears as a whole: written beside its place, then renamed."""
    temporary, fs = _fs(spark, f"{path}.tmp")
    out = fs.create(temporary, True)
    out.write(text.encode())
    out.close()
    target = _fs(spark, path)[0]
    if overwrite and fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise StorageError(f"{path} cannot be written")


def save_task(spark: SparkSession, spool: str, task: dict) -> None:
    """State of a spooled task as <task_id>.json."""
    write_text(spark, f"{spool.rstrip('/')}/{task['task_id']}.json", json.dumps(task, sort_keys=True))


def spool_bytes(spark: SparkSession, spool: str, glob: str = "*") -> DataFrame:
    """Sum of the file sizes under a spool folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(spool)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def spool_has_room(used, size, most, available, least_free):
    """Of numbers or of columns."""
    return (used + size <= most) & (available >= size + least_free)


def above_low_water(available, total, size, least_free, least_percent):
    """Whether a file may be admitted: the space left after it is enough in bytes and in percent. Of numbers or of columns."""
    return (available >= size + least_free) & ((available - size) * 100 >= total * least_percent)


def capacity(spark: SparkSession, path: str) -> tuple[int, int]:
    """(available, total) bytes of the store of a path."""
    p, fs = _fs(spark, path)
    s = fs.getStatus(p)
    return s.getRemaining(), s.getCapacity()


def assemble(chunks: DataFrame, size: str = "file_size", chunk: str = "chunk_size") -> DataFrame:
    """(session, length, sha256, content) of sessions whose chunks (session, number, data, file_size, chunk_size) fill every position.

    A chunk's place is its number times the chunk size; of repeated numbers the
    least data counts. A file is one row, as long as the upload limit allows.
    """
    one = chunks.groupBy("session", "number").agg(F.min("data").alias("data"), F.max(size).alias("s"), F.max(chunk).alias("c"))
    # the place that data of the right length takes: all but the last are whole chunks
    fits = F.octet_length("data") == F.least(F.col("c"), F.col("s") - F.col("number") * F.col("c"))
    whole = one.where(fits).groupBy("session").agg(F.max("s").alias("s"), F.sort_array(F.collect_list(F.struct("number", "data"))).alias("x"))
    # joined as hex in one go: a fold of concatenations copies what it has with each chunk
    data = F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["data"])), ""))
    return whole.withColumn("content", data).where(F.octet_length("content") == F.col("s")).select("session", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"), "content")


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Writes tables under path, which must not exist, and a manifest of counts and order-free digests, last of all."""
    manifest = {}
    for name, df in sorted(tables.items()):
        df.write.mode("error").parquet(f"{path}/{name}")
        manifest[name] = digest(spark.read.parquet(f"{path}/{name}"))
    write_text(spark, f"{path}/manifest.json", json.dumps({"tables": manifest, "made_at": int(time.time())}, sort_keys=True))
    return manifest


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup, each checked against the manifest; StorageError names one that differs."""
    rows = spark.read.text(f"{path}/manifest.json", wholetext=True).first()
    out = {}
    for name, want in json.loads(rows["value"])["tables"].items():
        out[name] = spark.read.parquet(f"{path}/{name}")
        if digest(out[name]) != want:
            raise StorageError(f"{name} is not what was backed up")
    return out


def digest(df: DataFrame) -> dict:
    """Count and order-free digest of the rows, so that no task reads a whole table."""
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0)).alias("digest")).first()
    return {"rows": r["rows"], "digest": str(r["digest"])}


def migrate(spark: SparkSession, applied: dict[str, str], scripts: dict[str, str]) -> dict[str, str]:
    """Runs the SQL scripts that are not applied yet, in order of their names; an applied one that has changed since is an error. Returns name and checksum of all."""
    sums = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in scripts.items()}
    for name, pinned in applied.items():
        if sums.get(name, pinned) != pinned:
            raise StorageError(f"migration {name} has changed since it was applied")
    for name in sorted(scripts):
        if name not in applied:
            for statement in scripts[name].split(";"):
                if statement.strip():
                    spark.sql(statement)
    return applied | sums


def verify_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(relative_path, problem) of the files of a manifest (relative_path, file_size, sha256) that are missing or differ."""
    disk = read_files(spark, root).select("relative_path", "length", F.col("sha256").alias("__sha"))
    j = manifest.join(disk, "relative_path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("file_size"), "size").when(F.col("__sha") != F.col("sha256"), "sha256")
    return j.select("relative_path", problem.alias("problem")).where("problem IS NOT NULL")
