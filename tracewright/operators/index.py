"""Inverted index: immutable Parquet tables partitioned by batch.

documents, files, postings, terms, stats and blocks are folders of one root; a batch is
one ``batch_id=`` partition of each. A READY list names the batches that
readers may see, so a batch appears as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.scalars import doc_id, tokens
from ..sources.files import utf8
from . import blocks

#: Row groups of documents: what a lookup reads at least.
ROW_GROUP_BYTES = 16 << 20
#: Neighbouring keys of a block whose counts are summed by one window, as a power of two.
BLOCK_BITS = 12
TABLES = ("documents", "files", "postings", "terms", "stats", "blocks")


def assign_ids(docs: DataFrame, batch_id: int) -> DataFrame:
    """local_id from 0 in archive and line order, nulls last, and doc_id.

    Positions are a sum over earlier archives plus the rank inside the archive,
    so no task sorts the whole batch. Both meet by sorting: there may be millions of archives.
    """
    # documents without an archive come after the largest id
    keyed = docs.withColumn("__a", F.coalesce(F.col("archive_id").cast("long"), F.lit((1 << 63) - 1)))
    counts = keyed.groupBy("__a").agg(F.count("*").alias("__n"))
    low, high = keyed.agg(F.min("__a"), F.max("__a")).first()
    before = _sums_before(counts, low or 0, high or 0)
    inside = F.row_number().over(W.partitionBy("__a").orderBy(F.col("archive_id").asc_nulls_last(), F.col("line_no").asc_nulls_last())) - 1
    out = keyed.withColumn("__in", inside).join(before.hint("merge"), "__a").withColumns({"batch_id": F.lit(batch_id).cast("long"), "local_id": (F.col("__before") + F.col("__in")).cast("long")}).drop("__a", "__in", "__before")
    return out.withColumn("doc_id", doc_id(F.col("batch_id"), F.col("local_id")))


def _sums_before(counts: DataFrame, low: int, high: int) -> DataFrame:
    """(__a, __before): __n over all smaller keys of (__a, __n), whose keys lie from low to high.

    Sums inside blocks of neighbouring keys, of these blocks inside larger ones and so on up to one block,
    so a window has at most 4096 rows whatever gaps the keys have.
    """
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__up").orderBy("__a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first, last = low >> BLOCK_BITS, high >> BLOCK_BITS
    # numbered from the first, or blocks on both sides of zero would never become one
    counts = counts.withColumn("__up", F.shiftright("__a", BLOCK_BITS) - first)
    sums = counts.withColumn("__before", inside).select("__a", "__up", "__before")
    if first == last:
        return sums.select("__a", "__before")
    heads = _sums_before(counts.groupBy(F.col("__up").alias("__a")).agg(F.sum("__n").alias("__n")), 0, last - first)
    heads = heads.select(F.col("__a").alias("__up"), F.col("__before").alias("__head"))
    return sums.join(heads.hint("merge"), "__up").select("__a", (F.col("__head") + F.col("__before")).alias("__before"))


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", with_length: bool = False) -> DataFrame:
    """(term, key, tf), and the document's length if wanted: counted with a map-side combine, as terms repeat in a document."""
    if with_length:
        words = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").cast("long").alias("length"), F.explode("w").alias("term"))
        return words.groupBy("term", key, "length").agg(F.count("*").alias("tf")).select("term", key, "tf", "length")
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def term_dictionary(posts: DataFrame) -> DataFrame:
    """(term, df, posting_begin, posting_count) with terms in byte order and contiguous postings.

    Begins are sums over all earlier terms: by first two bytes globally (a
    bounded table), then inside each such prefix.
    """
    df = posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("__p", F.substring(F.hex(F.col("term").cast("binary")), 1, 4))
    heads = df.groupBy("__p").agg(F.sum("df").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    inside = F.coalesce(F.sum("df").over(W.partitionBy("__p").orderBy("term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__in", inside).join(F.broadcast(heads), "__p").select("term", "df", (F.col("__before") + F.col("__in")).cast("long").alias("posting_begin"), F.col("df").alias("posting_count"))


def corpus_stats(docs: DataFrame, length: str = "term_count") -> DataFrame:
    """Documents, sum and average of their lengths; the average of nothing is 1."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total_terms"), F.coalesce(F.avg(length), F.lit(1.0)).alias("average_length"))


def segment_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("batch_id").agg(F.count("*").alias("documents"), F.sum("term_count").alias("total_terms"), F.avg("term_count").alias("average_length"), F.min("occurred_at_ms").alias("min_occurred_at_ms"), F.max("occurred_at_ms").alias("max_occurred_at_ms"))


def verify_originals(files: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Failures of files whose bytes are no longer what the archive recorded; empty if all are."""
    j = files.join(on_disk.select("relative_path", "length", "sha256"), "relative_path", "left")
    code = F.when(F.col("length").isNull(), "ARCHIVE_FILE_NOT_FOUND").when(F.col("length") != F.col("file_size"), "ARCHIVE_SIZE_MISMATCH").when(F.col("sha256") != F.col("file_sha256"), "ARCHIVE_SHA256_MISMATCH")
    return j.withColumn("failure_code", code).where("failure_code IS NOT NULL").select("archive_id", "failure_code")


def curve(columns: list[Column], bits: int = 10) -> Column:
    """Position on a space-filling curve: the bits of several numbers below 2^bits, interleaved."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.getbit(c, F.lit(b)).cast("long"), b * len(columns) + i))
    return out


def write_documents(docs: DataFrame, path: str, block_bytes: int = ROW_GROUP_BYTES) -> None:
    """Documents along a curve over time, device and work order, in small row groups: a filter by any of them reads few, by their bounds of time or bloom filters, and a document is found by the filter of its id."""
    low, high = docs.agg(F.min("occurred_at_ms"), F.max("occurred_at_ms")).first()
    span = max(1, (high or 0) - (low or 0) + 1)
    when = F.floor((F.col("occurred_at_ms") - F.lit(low or 0)) * 1024 / span).cast("long")
    placed = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(1024).cast("long"))
    at = docs.withColumn("__at", curve([when, placed("device_id"), placed("work_order")])).repartitionByRange("__at").sortWithinPartitions("__at", "occurred_at_ms").drop("__at")
    writer = at.write.mode("overwrite").option("parquet.block.size", str(block_bytes))
    for c in ("doc_id", "device_id", "work_order"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def build_segment(docs: DataFrame, outcomes: DataFrame, batch_id: int, root: str) -> None:
    """Writes one batch's partitions; docs are parsed documents with their raw bytes. Refuses a batch that exists."""
    spark = docs.sparkSession
    d = assign_ids(docs, batch_id)
    where = lambda t: f"{root}/{t}/batch_id={batch_id}"
    write_documents(d.drop("raw", "batch_id"), where("documents"))
    posts = postings(d.withColumn("text", utf8(F.col("raw"))), with_length=True)
    posts.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("error").option("parquet.bloom.filter.enabled#term", "true").parquet(where("postings"))
    written = spark.read.parquet(where("postings"))
    term_dictionary(written).write.mode("error").parquet(where("terms"))
    blocks.write(_blocks(written), where("blocks"))
    outcomes.where("failure_code IS NULL").select("archive_id", "file_size", "file_sha256", "relative_path").write.mode("error").parquet(where("files"))
    segment_stats(spark.read.parquet(where("documents")).withColumn("batch_id", F.lit(batch_id).cast("long"))).drop("batch_id").write.mode("error").parquet(where("stats"))


def _blocks(posts: DataFrame) -> DataFrame:
    return blocks.of_postings(posts.select("term", F.col("doc_id").alias("id"), "tf", F.col("length").alias("len")))


SCHEMAS = {
    "documents": "doc_id long, batch_id long, local_id long, archive_id long, line_no long, byte_offset long, byte_length long, occurred_at_ms long, archived_at_ms long, term_count long, line_id string, station_id string, device_id string, collector_id string, work_order string, product_sn string, source_type string, level string, module_name string, error_code string, event_name string",
    "files": schemas.FILE, "postings": f"{schemas.POSTING}, length long", "terms": schemas.TERM, "blocks": "batch_id long, term string, block long, ids array<long>, tfs array<int>, lens array<int>, n int, max_tf int, min_len int",
    "stats": "batch_id long, documents long, total_terms long, average_length double, min_occurred_at_ms long, max_occurred_at_ms long",
}


def load(spark: SparkSession, root: str, table: str, ready: list[int | str]) -> DataFrame:
    """A table of the READY batches or named segments, nothing else read; batch_id is a long. None of them give no rows."""
    names = [n if isinstance(n, str) else f"batch_id={n}" for n in ready]
    single, merged = [n for n in names if n.startswith("batch_id=")], [n for n in names if not n.startswith("batch_id=")]
    parts = []
    if single:
        parts.append(spark.read.option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/{n}" for n in single]).withColumn("batch_id", F.col("batch_id").cast("long")))
    if merged:
        parts.append(spark.read.parquet(*[f"{root}/{table}/{n}" for n in merged]))
    if not parts:
        return spark.createDataFrame([], SCHEMAS[table])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def merge_segments(spark: SparkSession, root: str, names: list[str], target: str, without: int | None = None) -> dict[str, int]:
    """Writes one segment of several, less one batch: documents and postings sorted as in a batch, doc_ids as they are, one row of statistics. Returns the statistics."""
    t = {n: load(spark, root, n, names) for n in TABLES}
    if without is not None:
        t = {n: df.where(F.col("batch_id") != without) if n in ("documents", "files", "postings") else df for n, df in t.items()}
    where = lambda n: f"{root}/{n}/{target}"
    write_documents(t["documents"], where("documents"))
    t["postings"].repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(where("postings"))
    docs, posts = (spark.read.parquet(where(n)) for n in ("documents", "postings"))
    last = F.lit(docs.agg(F.max("batch_id")).first()[0]).cast("long").alias("batch_id")
    _blocks(posts).select("*", F.shiftright("block", 32 - blocks.BLOCK_BITS).alias("batch_id")).repartitionByRange("term").sortWithinPartitions("term", "block").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(where("blocks"))
    term_dictionary(posts).select("*", last).write.mode("overwrite").parquet(where("terms"))
    t["files"].write.mode("overwrite").parquet(where("files"))
    segment_stats(docs.withColumn("batch_id", last)).write.mode("overwrite").parquet(where("stats"))
    return {"documents": docs.count(), "postings": posts.count()}


def violations(docs: DataFrame, files: DataFrame, posts: DataFrame, terms: DataFrame, stats: DataFrame | None = None, merged: bool = False) -> DataFrame:
    """(rule, n) of the broken invariants of one batch, or of a merged segment, whose local ids are those of several; empty for a sound one.

    Documents meet postings by sorted joins: the ids of either are too many to
    be broadcast, however small their files.
    """
    checks = [] if merged else [
        ("local_id_not_contiguous", docs.agg(((F.count("*") != F.count_distinct("local_id")) | (F.min("local_id") != 0) | (F.max("local_id") != F.count("*") - 1)).cast("long").alias("n"))),
    ]
    checks += [
        ("doc_id_formula", docs.agg(F.count_if(~F.col("doc_id").eqNullSafe(doc_id(F.col("batch_id"), F.col("local_id")))).alias("n"))),
        ("unknown_file", docs.join(F.broadcast(files), "archive_id", "left_anti").agg(F.count("*").alias("n"))),
        ("range_outside_file", docs.join(F.broadcast(files), "archive_id").agg(F.count_if((F.col("byte_offset") < 0) | (F.col("byte_offset") + F.col("byte_length") > F.col("file_size"))).alias("n"))),
        ("empty_field", docs.agg(F.count_if(F.expr("coalesce(line_id, '') = '' OR coalesce(station_id, '') = '' OR coalesce(device_id, '') = '' OR coalesce(level, '') = '' OR coalesce(module_name, '') = ''")).alias("n"))),
        ("term_frequency", posts.agg(F.count_if(F.col("tf") <= 0).alias("n"))),
        ("repeated_posting", posts.groupBy("term", "doc_id").count().agg(F.count_if(F.col("count") > 1).alias("n"))),
        ("posting_without_document", posts.join(docs.hint("merge"), "doc_id", "left_anti").agg(F.count("*").alias("n"))),
        ("df_differs", posts.groupBy("term").agg(F.count("*").alias("c")).join(terms, "term", "full").agg(F.count_if(~F.col("c").eqNullSafe(F.col("df")) | ~F.col("df").eqNullSafe(F.col("posting_count"))).alias("n"))),
        ("length_differs", posts.groupBy("doc_id").agg(F.sum("tf").alias("s")).join(docs.hint("merge"), "doc_id", "right").agg(F.count_if(F.coalesce("s", F.lit(0)) != F.col("term_count")).alias("n"))),
        ("postings_not_contiguous", terms.agg((F.coalesce(F.sum("posting_count"), F.lit(0)) != F.coalesce(F.max(F.col("posting_begin") + F.col("posting_count")), F.lit(0))).cast("long").alias("n"))),
        ("repeated_begin", terms.groupBy("posting_begin").count().agg(F.count_if(F.col("count") > 1).alias("n"))),
    ]
    if stats is not None:
        real = docs.agg(F.count("*").alias("c"), F.coalesce(F.sum("term_count"), F.lit(0)).alias("t"), F.min("occurred_at_ms").alias("a"), F.max("occurred_at_ms").alias("b")).withColumn("j", F.lit(1))
        said = stats.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("total_terms"), F.lit(0)).alias("total"), F.max("average_length").alias("avg"), F.min("min_occurred_at_ms").alias("low"), F.max("max_occurred_at_ms").alias("high")).withColumn("j", F.lit(1))
        equal = (F.col("c") == F.col("documents")) & (F.col("t") == F.col("total")) & F.col("a").eqNullSafe(F.col("low")) & F.col("b").eqNullSafe(F.col("high")) & ((F.col("c") == 0) | (F.abs(F.col("avg") - F.col("t") / F.col("c")) <= 1e-9))
        checks.append(("statistics_differ", real.join(said, "j").agg(F.count_if(~F.coalesce(equal, F.lit(False))).alias("n"))))
    out = None
    for rule, q in checks:
        row = q.select(F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        out = row if out is None else out.union(row)
    return out.where("n > 0")
