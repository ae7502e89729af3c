"""Lines of files by byte ranges: any file is read by as many tasks as it has ranges, once.

Spark's text source cuts files into ranges, skips to the first line feed of a
range and reads past its end, in any store that Spark reads. What it does not
say is where a line lies: a pass over the rows as they are read numbers the
lines of each range and sums their bytes, and leaves a summary of the range;
lines before and bytes before a range are sums over the summaries of earlier
ones. The digest of a file that is one range is taken in the same pass. SHA-256
has no parts to combine, so the lines of a file of several ranges stream once
more, in order, through one task for each file, which holds a batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the pass: lines have a number in their range, a summary has none and holds the range's lines, bytes and, if it is a whole file, digest.
SCAN = "path string, start long, i long, at long, raw binary, lines long, bytes long, size long, sha256 string"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("i", pa.int64()), ("at", pa.int64()), ("raw", pa.binary()), ("lines", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


#: The text source takes a byte order mark away from the first line of a file; that the file is longer by it tells.
MARK = b"\xef\xbb\xbf"


class _Digest:
    """SHA-256 of lines joined by line feeds, with and without a mark before them; whether the last line has a line feed, and the file a mark, follows from its size."""

    def __init__(self) -> None:
        self.plain, self.marked, self.bytes = hashlib.sha256(), hashlib.sha256(MARK), 0

    def add(self, lines: list[bytes]) -> None:
        data = b"\n".join(lines)
        data = b"\n" + data if self.bytes else data
        self.plain.update(data)
        self.marked.update(data)
        self.bytes += len(data) + (0 if self.bytes else 1)

    def hexdigest(self, size: int) -> str:
        rest = size - self.bytes
        used = self.marked if rest >= len(MARK) - 1 else self.plain
        if rest in (0, len(MARK)):
            used.update(b"\n")
        return used.hexdigest()


def _number(keep_raw: bool):
    """Numbers the lines of each range; keep_raw: of all files, else of those of several ranges, whose digest needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, i, at, digest = None, 0, 0, None

        def summary() -> pa.RecordBatch:
            path, start, _, size = key
            row = {"path": path, "start": start, "lines": i, "bytes": at, "size": size, "sha256": digest.hexdigest(size) if digest else None}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            paths, starts, lengths, sizes, raw = (b.column(c) for c in range(5))
            keys = list(zip(paths.to_pylist(), starts.to_pylist(), lengths.to_pylist(), sizes.to_pylist(), strict=True))
            low = 0
            while low < len(keys):
                high = low + 1
                while high < len(keys) and keys[high] == keys[low]:
                    high += 1
                if keys[low] != key:
                    if key is not None:
                        yield summary()
                    key, i, at = keys[low], 0, 0
                    digest = _Digest() if key[1] == 0 and key[2] >= key[3] else None
                part = raw.slice(low, high - low)
                lines = part.to_pylist()
                if digest:
                    digest.add(lines)
                ats = []
                for line in lines:
                    ats.append(at)
                    at += len(line) + 1
                if keep_raw or digest is None:
                    n = len(lines)
                    nothing = [pa.nulls(n, t) for t in _ARROW.types[5:]]
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), pa.array(ats, pa.int64()), pa.array(lines, pa.binary()), *nothing], schema=_ARROW)
                i += len(lines)
                low = high
        if key is not None:
            yield summary()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256) of files whose lines stream by in order."""
    schema = pa.schema([("path", pa.string()), ("sha256", pa.string())])
    path, digest, size = None, None, 0
    for b in batches:
        low, paths, sizes, raw = 0, b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        while low < len(paths):
            high = low + 1
            while high < len(paths) and paths[high] == paths[low]:
                high += 1
            if paths[low] != path:
                if path is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest(size)])], schema=schema)
                path, digest, size = paths[low], _Digest(), sizes[low]
            digest.add(raw.slice(low, high - low).to_pylist())
            low = high
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest(size)])], schema=schema)


def _literal(path: str) -> str:
    """A path that Spark does not take for a pattern."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


class LineScan:
    """The lines and digests of some files, from one pass that is written to ``at`` and read from there.

    ``files`` gives each file's relative path and length, as listed. A line of
    more than 2 GB is beyond the text source.
    """

    def __init__(self, spark: SparkSession, root: str, files: dict[str, int], at: str, keep_raw: bool = True):
        self.spark, self.listed = spark, files
        self.base = root.rstrip("/")
        some = [p for p, n in files.items() if n]
        if some:
            text = spark.read.option("lineSep", "\n").text([_literal(f"{self.base}/{p}") for p in some])
            m = F.col("_metadata")
            rows = text.select(m["file_path"].alias("path"), m["file_block_start"].alias("start"), m["file_block_length"].alias("length"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("raw"))
            self.source = rows.mapInArrow(_number(keep_raw), SCAN)
            self.source.write.mode("overwrite").parquet(at)
            stored = spark.read.schema(SCAN).parquet(at)
        else:
            stored = self.source = spark.createDataFrame([], SCAN)
        # the source gives paths as URIs, of which the base's path is a part
        before = spark._jvm.org.apache.hadoop.fs.Path(self.base).toUri().getRawPath().rstrip("/") + "/"
        encoded = F.substring(F.col("path"), F.instr("path", before) + len(before), F.length("path"))
        path = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
        self.stored = stored.withColumn("relative_path", path)

    def summaries(self) -> DataFrame:
        """A row for each range, with the lines and bytes of the file's ranges before it, and the bytes of a mark that the first line lacks."""
        before = W.partitionBy("relative_path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
        none = F.lit(0).cast("long")
        s = self.stored.where("i IS NULL").select("relative_path", "start", "lines", "bytes", "size", "sha256")
        whole = F.col("size") - F.sum("bytes").over(W.partitionBy("relative_path"))
        s = s.withColumn("mark", F.when(whole >= len(MARK) - 1, len(MARK)).otherwise(0))
        return s.select("*", F.coalesce(F.sum("lines").over(before), none).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), none).alias("bytes_before"))

    def lines(self) -> DataFrame:
        """(relative_path, line_no, byte_offset, byte_length, raw): as files.lines gives them, raw as ISO-8859-1 text without one CR at its end."""
        rows = self.stored.where("i IS NOT NULL").select("relative_path", "start", "i", "at", "raw")
        # a row for each range, whatever the compressed lines seem to be
        rows = rows.join(F.broadcast(self.summaries().select("relative_path", "start", "lines_before", "bytes_before", "mark")), ["relative_path", "start"])
        first = (F.col("start") == 0) & (F.col("i") == 0)
        data = F.when(first & (F.col("mark") > 0), F.concat(F.lit(MARK), F.col("raw"))).otherwise(F.col("raw"))
        raw = F.regexp_replace(F.decode(data, "ISO-8859-1"), r"\r\z", "")
        at = F.col("bytes_before") + F.col("at") + F.when(first, 0).otherwise(F.col("mark"))
        bare = self._bare().select("relative_path", *[F.lit(n).cast("long") for n in (1, 0, len(MARK))], F.lit(MARK.decode("latin-1")))
        return bare.toDF("relative_path", "line_no", "byte_offset", "byte_length", "raw").union(rows.select("relative_path", (F.col("lines_before") + F.col("i") + 1).alias("line_no"), at.alias("byte_offset"), F.length(raw).cast("long").alias("byte_length"), raw.alias("raw")))

    def _listed(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.listed.items()), "relative_path string, length long")

    def _bare(self) -> DataFrame:
        """Files of a mark alone, of which the text source gives no line, so no range."""
        return self._listed().where(F.col("length") == len(MARK)).join(self.stored.where("i IS NULL").select("relative_path"), "relative_path", "left_anti")

    def digests(self) -> DataFrame:
        """(relative_path, length, sha256) of every listed file."""
        whole = self.stored.where("sha256 IS NOT NULL").select("relative_path", "sha256")
        parts = self.stored.where("i IS NULL AND sha256 IS NULL").select("relative_path", "size").distinct()
        cut = self.stored.where("i IS NOT NULL").select("relative_path", "start", "i", "raw").join(F.broadcast(parts), "relative_path")
        ordered = cut.repartition("relative_path").sortWithinPartitions("relative_path", "start", "i").select("relative_path", "size", "raw")
        found = whole.union(ordered.mapInArrow(_digests, "path string, sha256 string")).union(self._bare().select("relative_path", F.lit(hashlib.sha256(MARK).hexdigest())))
        return self._listed().join(found, "relative_path", "left").withColumn("sha256", F.when(F.col("length") == 0, EMPTY_SHA256).otherwise(F.col("sha256")))

