"""Control tables of indexing: batch and archive states as projections of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_STATES = ("PARSING", "PARSED", "BUILDING", "READY", "FAILED")
ARCHIVE_STATES = ("PENDING", "PARSED", "INDEXED", "FAILED")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key by ``order``; a new row wins a tie. An aggregation, so a hot key is combined map-side."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*table.columns), F.struct(order, "__new")).alias("r")).select("r.*")


def attach(indexed: DataFrame, archives: DataFrame, batch_id: int) -> DataFrame:
    """Puts archives under a batch as PENDING, whatever they were."""
    ids = archives.select("archive_id").distinct()
    fresh = ids.select("archive_id", F.lit(batch_id).cast("long").alias("batch_id"), F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("document_count"), F.lit(None).cast("string").alias("failure_code"))
    return indexed.join(ids, "archive_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def apply_outcomes(indexed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """PENDING rows become PARSED or FAILED by their outcome, with its count, code, line and profile where the tables have these columns."""
    given = [c for c in ("failure_code", "document_count", "failure_line", "profile_name") if c in outcomes.columns]
    o = outcomes.select("archive_id", *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__o"))
    j = indexed.join(o, "archive_id", "left")
    now = F.col("__o") & (F.col("state") == "PENDING")
    new = {"state": F.when(F.col("__failure_code").isNull(), "PARSED").otherwise("FAILED"), "document_count": F.col("__document_count"), "failure_code": F.col("__failure_code")}
    if "failure_line" in indexed.columns and "failure_line" in given:
        new["failure_line"] = F.col("__failure_line")
    if "parser_profile" in indexed.columns and "profile_name" in given:
        new |= {"parser_profile": F.col("__profile_name"), "parser_version": F.when(F.col("__profile_name").isNotNull(), 1)}
    return j.withColumns({k: F.when(now, v).otherwise(F.col(k)) for k, v in new.items()}).select(indexed.columns)


def move_batch(batches: DataFrame, batch_id: int, source: str, target: str, failure: str | None = None) -> tuple[DataFrame, bool]:
    """Compare-and-set of one batch's state; False where it was not in ``source``."""
    hit = (F.col("batch_id") == batch_id) & (F.col("state") == source)
    changed = not batches.where(hit).isEmpty()
    out = batches.withColumns({"failure_code": F.when(hit, F.lit(failure)).otherwise(F.col("failure_code")), "state": F.when(hit, F.lit(target)).otherwise(F.col("state"))})
    return out, changed


def publish_ready(batches: DataFrame, indexed: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """A BUILDING batch becomes READY and its PARSED archives INDEXED, in one step."""
    ready = batches.where((F.col("batch_id") == batch_id) & (F.col("state") == "BUILDING")).select("batch_id", F.lit(True).alias("__r"))
    b = batches.join(F.broadcast(ready), "batch_id", "left").withColumn("state", F.when(F.col("__r"), "READY").otherwise(F.col("state"))).drop("__r")
    i = indexed.join(F.broadcast(ready), "batch_id", "left").withColumn("state", F.when(F.col("__r") & (F.col("state") == "PARSED"), "INDEXED").otherwise(F.col("state"))).drop("__r")
    return b, i.select(indexed.columns)


def recover(batches: DataFrame, built: list[int], sound: list[int]) -> DataFrame:
    """After a crash: PARSING fails; BUILDING without a segment is PARSED again, with a sound one READY, with a broken one FAILED."""
    building = F.col("state") == "BUILDING"
    state = F.when(F.col("state") == "PARSING", "FAILED").when(building & ~F.col("batch_id").isin(built), "PARSED").when(building & F.col("batch_id").isin(sound), "READY").when(building, "FAILED").otherwise(F.col("state"))
    code = F.when(F.col("state") == "PARSING", "BATCH_INTERRUPTED").when(building & F.col("batch_id").isin(built) & ~F.col("batch_id").isin(sound), "SEGMENT_RECOVERY_CORRUPTED").otherwise(F.col("failure_code"))
    return batches.select(*[c for c in batches.columns if c not in ("state", "failure_code")], code.alias("failure_code"), state.alias("state"))


def request_rebuild(batches: DataFrame, indexed: DataFrame, archive_id: int) -> tuple[DataFrame, DataFrame]:
    """Invalidates the whole batch of an archive: FAILED / REBUILD_REQUESTED, and all its archives PENDING."""
    hit = indexed.where(F.col("archive_id") == archive_id).select("batch_id").withColumn("__r", F.lit(True))
    b = batches.join(F.broadcast(hit), "batch_id", "left").withColumns({"state": F.when(F.col("__r"), "FAILED").otherwise(F.col("state")), "failure_code": F.when(F.col("__r"), "REBUILD_REQUESTED").otherwise(F.col("failure_code"))}).drop("__r")
    i = indexed.join(F.broadcast(hit), "batch_id", "left").withColumns({"state": F.when(F.col("__r"), "PENDING").otherwise(F.col("state")), "document_count": F.when(F.col("__r"), 0).otherwise(F.col("document_count")), "failure_code": F.when(F.col("__r"), F.lit(None)).otherwise(F.col("failure_code"))}).drop("__r")
    return b.select(batches.columns), i.select(indexed.columns)


def state_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("state").count().orderBy("state")


def ready_list(batches: DataFrame) -> list[int]:
    """Snapshot: READY batches in order; pinned on the driver for the life of a query."""
    return [r["batch_id"] for r in batches.where("state = 'READY'").select("batch_id").orderBy("batch_id").collect()]
