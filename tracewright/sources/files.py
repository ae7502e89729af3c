"""File sources: byte-exact line scans, single records, device folders and sidecars."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.scalars import chunk_count, iso_to_ms, let
from .ranges import LineScan

FILES = "relative_path string, length long, sha256 string, content binary"
IGNORED = r"(^\.|\.meta\.json\z|\.done\z|\.tmp\z|\.part\z)"
#: Lines whose offsets are summed in one go; a sum copies what it has so far.
BLOCK_LINES = 256


def read_files(spark: SparkSession, root: str, glob: str = "*", paths: list[str] | None = None) -> DataFrame:
    """(relative_path, length, sha256, content) of files under root; content is read only where a query needs it.

    With ``paths`` only these files are opened and nothing is listed; missing
    ones and paths that leave the root are left out. A file is one row, so it
    must fit in a task.
    """
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    if paths is None:
        files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    else:
        found = [f"{base}/{p}" for p in sorted(set(paths)) if safe_path(p) and _is_file(spark, f"{base}/{p}")]
        if not found:
            return spark.createDataFrame([], FILES)
        files = reader.load(found)
    prefix = re.sub(r"^file:/+", "/", base) + "/"
    return files.select(F.element_at(F.split("path", _quoted(prefix)), -1).alias("relative_path"), "length", F.sha2("content", 256).alias("sha256"), "content")


class Archive:
    """The archived files under a root, opened by their paths."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def files(self, paths: list[str]) -> DataFrame:
        return read_files(self.spark, self.root, paths=paths)

    def listed(self, paths: list[str]) -> dict[str, int]:
        """Lengths of those paths that are files inside the root."""
        found = {p: _file_size(self.spark, f"{self.root.rstrip('/')}/{p}") for p in sorted(set(paths)) if safe_path(p)}
        return {p: n for p, n in found.items() if n is not None}

    def scan(self, paths: list[str], at: str, keep_raw: bool = True) -> LineScan:
        """Lines and digests of some files, by byte ranges in one pass that is stored in ``at``; missing files and paths that leave the root are left out."""
        return LineScan(self.spark, self.root, self.listed(paths), at, keep_raw)

    def record(self, path: str, size: int, offset: int, length: int) -> bytes | None:
        """The bytes of one record, read from their place alone; None where the file's size is not the recorded one or the range is outside."""
        if self.listed([path]).get(path) != size or not (0 <= offset and 0 <= length and offset + length <= size):
            return None
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{path}")
        stream = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(p)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()


def _file_size(spark: SparkSession, path: str) -> int | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    return status.getLen() if status.isFile() else None


def _is_file(spark: SparkSession, path: str) -> bool:
    return _file_size(spark, path) is not None


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per physical line: line_no from 1, byte_offset, byte_length and raw, the line's bytes as ISO-8859-1 text.

    Lines end at LF; one CR before it is no part of the line, but of the offsets.
    A last line without LF counts, an empty rest does not. Bytes map to
    characters one to one, so lengths and offsets are bytes whatever the encoding.
    """
    text = F.decode(F.col(content), "ISO-8859-1")
    parts = F.split(text, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = files.withColumn("__p", whole)
    zipped = let(F.col("__p"), lambda p: F.arrays_zip(p.alias("p"), _offsets(p).alias("o")))
    out = out.withColumn("__z", zipped)
    out = out.select(*files.columns, F.posexplode("__z").alias("__i", "__z"))
    raw = F.regexp_replace(F.col("__z.p"), r"\r\z", "")
    return out.select(*[c for c in files.columns if c != content], (F.col("__i") + 1).cast("long").alias("line_no"), F.col("__z.o").alias("byte_offset"), F.length(raw).cast("long").alias("byte_length"), raw.alias("raw"))


def _offsets(parts: Column) -> Column:
    """Where each line starts: running sums of length + 1 by blocks, since a sum copies what it has so far, then moved by the sums of the blocks before."""
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("o"))
    add = lambda size: lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["o"], F.array(a["at"])).alias("o"))
    count = F.ceil(F.size(parts) / BLOCK_LINES).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(F.slice(parts, b * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), zero, add(lambda x: F.length(x) + 1)))
    moved = lambda b: let(F.aggregate(b, zero, add(lambda x: x["at"]))["o"], lambda s: F.flatten(F.transform(b, lambda x, i: F.transform(x["o"], lambda y: y + F.get(s, i)))))
    short = F.aggregate(parts, zero, add(lambda x: F.length(x) + 1))["o"]
    return F.when(F.size(parts) <= BLOCK_LINES, short).otherwise(let(blocks, moved))


def utf8(raw: Column) -> Column:
    """Text of raw bytes held as ISO-8859-1; null where they are no valid UTF-8."""
    data = F.encode(raw, "ISO-8859-1")
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def read_record(files: DataFrame | Archive, path: str, size: int, offset: int, length: int) -> DataFrame:
    """The exact bytes of one record, or a failure where the file's size is not the recorded one or the range is outside. From an archive only these bytes are read."""
    if isinstance(files, Archive):
        raw = files.record(path, size, offset, length)
        return files.spark.createDataFrame([(raw, "STORAGE_IO_ERROR" if raw is None else None)], "raw binary, failure string")
    one = files.where(F.col("relative_path") == path)
    good = (F.col("length") == size) & F.lit(0 <= offset and length >= 0 and offset + length <= size)
    return one.select(F.when(good, F.expr(f"substring(content, {offset + 1}, {length})")).alias("raw"), F.when(~good, "STORAGE_IO_ERROR").alias("failure"))


def safe_path(relative: str) -> bool:
    """False for absolute and empty paths and for empty, . and .. parts."""
    return bool(relative) and not posixpath.isabs(relative) and all(p not in ("", ".", "..") for p in relative.split("/"))


def safe(relative: Column) -> Column:
    """The same rule as a column; null is unsafe."""
    return F.coalesce((F.length(relative) > 0) & ~relative.rlike(r"(^|/)(\.{0,2})(/|\z)"), F.lit(False))


def device_inputs(names: DataFrame, col: str = "name") -> DataFrame:
    """Names of a device folder that are inputs: no dot-files, sidecars, markers or unfinished files."""
    return names.where(~F.col(col).rlike(IGNORED))


def sidecars(rows: DataFrame, json_col: str = "json", size: str = "file_size", chunk_size: int = 1 << 20) -> DataFrame:
    """rows and the five sidecar fields, chunk_count and sidecar_ok: exactly these keys, strings or (three of them) nulls, a strict time."""
    j = F.col(json_col)
    keys = F.array_sort(F.json_object_keys(j))
    s = F.from_json(j, schemas.SIDECAR)
    text = lambda k: F.get_json_object(j, f"$.{k}")
    strings = ~j.rlike(r'"(?:work_order|product_sn|file_type|result|produced_at)"\s*:\s*(?:[\[{0-9-]|true|false)')
    ok = (keys == F.array(*[F.lit(k) for k in sorted(x.split()[0] for x in schemas.SIDECAR.split(", "))])) & strings & text("file_type").isNotNull() & iso_to_ms(text("produced_at")).isNotNull()
    out = rows.withColumns({k: s[k] for k in ("work_order", "product_sn", "file_type", "result", "produced_at")})
    return out.withColumns({"chunk_count": chunk_count(F.col(size), F.lit(chunk_size)), "sidecar_ok": F.coalesce(ok, F.lit(False))})


def jsonl_ok(text: Column) -> Column:
    """JSON lines must end with LF and have no empty line."""
    return F.coalesce(text.endswith("\n") & ~text.rlike(r"(^|\n)\n") & (F.length(text) > 0), F.lit(False))


def spool_states(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Task state files named <task_id>.json; others and mismatched names are left out."""
    rows = spark.read.schema(schema).json(root, pathGlobFilter="*.json", multiLine=True).withColumn("__f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where(F.col("__f").rlike(r"^[0-9a-f]{64}\.json\z") & (F.col("__f") == F.concat("task_id", F.lit(".json")))).drop("__f")
