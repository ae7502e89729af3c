"""Archive metadata scans over a table with the archive columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import ARCHIVE_REQUIRED

INDEXED_TYPES = ("RUNTIME_LOG", "TEST_REPORT")
#: How far below the high-water mark ids may still appear, and how many ranges of missing ids are kept.
LATE_SPAN, MAX_GAPS = 1_000_000, 256


def list_after(archives: DataFrame, after: int, limit: int) -> DataFrame:
    """The next indexable rows above a high-water mark, in order of id."""
    return archives.where((F.col("archive_id") > after) & F.col("file_type").isin(*INDEXED_TYPES)).orderBy("archive_id").limit(limit)


def undiscovered(archives: DataFrame, observed: DataFrame, limit: int) -> DataFrame:
    """The same by an anti-join, so that ids committed out of order are found too."""
    return archives.where(F.col("file_type").isin(*INDEXED_TYPES)).join(observed.select("archive_id"), "archive_id", "left_anti").orderBy("archive_id").limit(limit)


def discover(archives: DataFrame, high: int, gaps: list[list[int]], limit: int, late_span: int = LATE_SPAN) -> tuple[list[int], int, list[list[int]]]:
    """(ids, high, gaps): the next indexable ids, and the offsets after them.

    Offsets are a high-water mark and the ranges of ids below it that no row had
    yet. Late rows are looked for in these ranges alone and new ones in windows
    above the mark, which widen where ids are sparse, so a call reads what it
    finds and not what was found before. Ranges more than late_span below the
    mark, or beyond MAX_GAPS of them, are given up; ``undiscovered`` finds what
    comes in those.
    """
    key, kind = F.col("archive_id"), F.col("file_type")
    ids: list[int] = []
    if gaps:
        inside = reduce(lambda a, b: a | b, [key.between(a, b) for a, b in gaps])
        late = archives.where(inside).select(key, kind.isin(*INDEXED_TYPES).alias("indexed")).orderBy(key).limit(4 * limit).collect()
        for r in late:
            if len(ids) == limit:
                break
            gaps = _without(gaps, r["archive_id"])
            ids += [r["archive_id"]] if r["indexed"] else []
    low, width = high, 4 * limit
    while len(ids) < limit:
        rows = archives.where((key > low) & (key <= low + width)).select(key, kind.isin(*INDEXED_TYPES).alias("indexed")).orderBy(key).limit(4 * limit).collect()
        if not rows:
            if archives.where(key > low + width).isEmpty():
                break
            low, width = low + width, 8 * width
            continue
        for r in rows:
            if len(ids) == limit:
                break
            if r["archive_id"] > high + 1:
                gaps = [*gaps, [high + 1, r["archive_id"] - 1]]
            high = low = r["archive_id"]
            ids += [r["archive_id"]] if r["indexed"] else []
    return ids, high, [[a, b] for a, b in gaps if b > high - late_span][-MAX_GAPS:]


def _without(gaps: list[list[int]], one: int) -> list[list[int]]:
    out = []
    for a, b in gaps:
        out += [[x, y] for x, y in ((a, one - 1), (one + 1, b)) if x <= y] if a <= one <= b else [[a, b]]
    return out


def find_by_ids(archives: DataFrame, ids: list[int]) -> DataFrame:
    """Exactly the rows of a list of ids, in order; fails at run time where one is missing or not indexable."""
    want = sorted(set(ids))
    rows = archives.where(F.col("archive_id").isin(want) & F.col("file_type").isin(*INDEXED_TYPES))
    n = rows.agg(F.count("*").alias("__n"))
    checked = n.select(F.assert_true(F.col("__n") == len(want), "archives are missing").alias("__ok"), F.lit(1).alias("__j"))
    return rows.withColumn("__j", F.lit(1)).join(F.broadcast(checked), "__j").where("__ok IS NULL").drop("__j", "__ok").orderBy("archive_id")


def decode_guard(archives: DataFrame) -> DataFrame:
    """Fails the query on a row with a missing required value, id or size 0, or a hash that is not 64 hex digits."""
    ok = (F.col("archive_id") > 0) & (F.col("file_size") > 0) & F.col("file_sha256").rlike(r"^[0-9a-f]{64}\z")
    for c in ARCHIVE_REQUIRED:
        ok = ok & F.col(c).isNotNull()
    # the check is part of a column that is kept, so it cannot be pruned away
    return archives.withColumn("archive_id", F.when(F.assert_true(F.coalesce(ok, F.lit(False)), "invalid archive row").isNull(), F.col("archive_id")))


def profiles(table: DataFrame) -> DataFrame:
    return table.where("enabled").select("device_id", "file_type", "profile_name", F.lit(1).alias("parser_version"))


def pending(indexed: DataFrame, limit: int) -> DataFrame:
    return indexed.where("state = 'PENDING'").select("archive_id").orderBy("archive_id").limit(limit)


def batches(table: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    out = table.where(F.col("state") == state).orderBy("batch_id")
    return out if limit is None else out.limit(limit)


def high_water_mark(indexed: DataFrame) -> DataFrame:
    return indexed.agg(F.coalesce(F.max("archive_id"), F.lit(0)).cast("long").alias("high_water_mark"))


def lookup(archives: DataFrame, **key) -> DataFrame:
    """The row of one archive_id or upload_id."""
    (name, value), = key.items()
    return archives.where(F.col(name) == value).limit(1)
