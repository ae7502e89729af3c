"""Archive metadata: keyset pages, lookups, dimension joins and integrity audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cursor_encode

DEFAULT_PAGE, MAX_PAGE, MAX_RANGE_DAYS = 50, 100, 31
DAY_MS = 86_400_000
FILTERS = ("device_id", "station_id", "work_order", "product_sn", "file_type", "result")


@dataclass
class ArchiveQuery:
    device_id: str | None = None
    station_id: str | None = None
    work_order: str | None = None
    product_sn: str | None = None
    file_type: str | None = None
    result: str | None = None
    time_from: int | None = None
    time_to: int | None = None
    cursor: tuple[int, int] | None = None
    page_size: int = DEFAULT_PAGE


def validate(q: ArchiveQuery) -> ArchiveQuery:
    """A work order, a serial number or a time range is required; a device alone is not enough."""
    for name in FILTERS:
        value = getattr(q, name)
        if value is not None and not (0 < len(value) <= 128 and all(0x20 <= ord(c) <= 0x7E for c in value)):
            raise ValueError(f"bad {name}")
    if (q.time_from is None) != (q.time_to is None) or (q.time_from is not None and not 0 <= q.time_to - q.time_from <= MAX_RANGE_DAYS * DAY_MS):
        raise ValueError("bad time range")
    if not (q.work_order or q.product_sn or q.time_from is not None):
        raise ValueError("a selective filter is required")
    if not 1 <= q.page_size <= MAX_PAGE:
        raise ValueError("bad page size")
    return q


def after_cursor(ms: Column, row_id: Column, cursor: tuple[int, int]) -> Column:
    at, last = cursor
    return (ms < at) | ((ms == at) & (row_id < last))


def matching(archives: DataFrame, q: ArchiveQuery) -> DataFrame:
    for name in FILTERS:
        if getattr(q, name) is not None:
            archives = archives.where(F.col(name) == getattr(q, name))
    if q.time_from is not None:
        # compared as timestamps, so that the range reaches the scan's statistics
        archives = archives.where(F.col("archived_at").between(F.timestamp_millis(F.lit(q.time_from)), F.timestamp_millis(F.lit(q.time_to))))
    return archives


def list_page(archives: DataFrame, q: ArchiveQuery) -> DataFrame:
    """page_size + 1 rows of the keyset page, newest first: the extra row tells that there is more."""
    ms = F.unix_millis("archived_at")
    archives = matching(archives, q)
    if q.cursor is not None:
        archives = archives.where(F.col("archived_at") <= F.timestamp_millis(F.lit(q.cursor[0]))).where(after_cursor(ms, F.col("archive_id"), q.cursor))
    return archives.orderBy(F.desc("archived_at"), F.desc("archive_id")).limit(q.page_size + 1)


def page(archives: DataFrame, q: ArchiveQuery) -> tuple[list, bool, str | None]:
    """(rows, has_more, next cursor) of a bounded page."""
    rows = list_page(archives, validate(q)).withColumn("cursor", cursor_encode(F.unix_millis("archived_at"), F.col("archive_id"))).collect()
    more = len(rows) > q.page_size
    rows = rows[: q.page_size]
    return rows, more, rows[-1]["cursor"] if more else None


def full(archives: DataFrame) -> DataFrame:
    """All sixteen columns; a binary digest becomes lower hex."""
    from ..functions.schemas import ARCHIVE

    columns = [c.split()[0] for c in ARCHIVE.split(", ")]
    binary = dict(archives.dtypes)["file_sha256"] == "binary"
    return archives.select(*[F.lower(F.hex(c)).alias(c) if c == "file_sha256" and binary else F.col(c) for c in columns])


def source_columns(archives: DataFrame) -> DataFrame:
    """The fourteen columns that indexing reads: all but upload_id and result."""
    return full(archives).drop("upload_id", "result")


def summary(archives: DataFrame, detail: bool = False) -> DataFrame:
    null = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    cols = ["archive_id", "line_id", "station_id", "device_id", null("work_order"), null("product_sn"), "file_type", null("result"), "original_filename", "file_size", "archived_at"]
    return archives.select(*cols, *(["upload_id", "collector_id", "relative_path", "file_sha256", "produced_at"] if detail else []))


def device_identity(devices: DataFrame, stations: DataFrame, lines: DataFrame) -> DataFrame:
    """Devices with their station and line, and whether all three are enabled."""
    s = stations.select("station_id", "line_id", "station_type", F.col("enabled").alias("__s"))
    n = lines.select("line_id", F.col("enabled").alias("__l"))
    return devices.join(s, "station_id").join(n, "line_id").withColumn("all_enabled", F.col("enabled") & F.col("__s") & F.col("__l")).drop("__s", "__l")


def authorised(pairs: DataFrame, bindings: DataFrame) -> DataFrame:
    return pairs.join(bindings.where("enabled"), ["collector_id", "device_id"], "left_semi")


def integrity_audit(archives: DataFrame, on_disk: DataFrame, full: bool = True) -> DataFrame:
    """archive_id and problem of the rows whose file is missing or differs; without ``full`` the bytes are not hashed."""
    j = archives.join(on_disk, "relative_path", "left")
    code = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("file_size"), "size")
    if full:
        code = code.when(F.col("sha256") != F.col("file_sha256"), "sha256")
    return j.withColumn("problem", code).where("problem IS NOT NULL").select("archive_id", "problem")


def integrity_summary(archives: DataFrame, problems: DataFrame) -> DataFrame:
    """Archives checked, and problems by kind."""
    kinds = ("missing", "size", "sha256")
    n = archives.agg(F.count("*").alias("checked"))
    return n.crossJoin(problems.agg(*[F.count_if(F.col("problem") == k).alias(k) for k in kinds]))  # one row each


def archive_record(sessions: DataFrame) -> DataFrame:
    """Archive rows of finished sessions: the session's metadata, its path and the time it was archived."""
    done = sessions.where("state IN ('VERIFYING', 'ARCHIVED') AND relative_path IS NOT NULL")
    return done.select("upload_id", "line_id", "station_id", "device_id", "collector_id", "work_order", "product_sn", "file_type", "result", "original_filename", "relative_path", "file_size", "file_sha256", "produced_at", "archived_at")


def orphans(on_disk: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return on_disk.join(known.select(key), key, "left_anti")


def insert_new(table: DataFrame, rows: DataFrame, key: str = "upload_id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows in conflict): a row whose key exists is a conflict, and the first of a key wins inside the batch."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "archive_id").alias("r")).select("r.*")
    return first.join(table.select(key), key, "left_anti").select(rows.columns), rows.join(table.select(key), key, "left_semi")
