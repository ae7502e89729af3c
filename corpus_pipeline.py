"""From raw documents to packed sequences: five stages, each written and read again by the next.

Every stage but the last returns the columns of documents, further ones
included, whatever their names. Rows without an id and rows that repeat one are
each judged by their own text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import read_table, scratch, stored
from tracewright.llm.decontaminate import decontaminate
from tracewright.llm.near_dup import near_duplicates
from tracewright.llm.packing import pack_documents
from tracewright.llm.pii import TEST_KEY, surrogates
from tracewright.llm.quality_classifier import classify


#: Columns that the stages read or change; all others travel as they are, packed into one.
READ = ("doc_id", "text", "lang", "source", "n_chars")

#: Numbers from here on stand for texts without an id of their own.
BEYOND_IDS = 1 << 62


def _packed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns beyond READ in one struct, so that no operator meets a name of its own, and the way back."""
    more = [c for c in docs.columns if c not in READ]
    if not more:
        return docs, lambda out: out.select(docs.columns)
    held = docs.select(*[c for c in docs.columns if c in READ], F.struct(*[F.col(f"`{c}`") for c in more]).alias("__more"))
    return held, lambda out: out.select(*[F.col(c) if c in READ else F.col("__more").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier holds to be junk or toxic, and those without a word."""
    held, unpacked = _packed(docs)
    return unpacked(classify(held, read_table(spark, sf_dir, "labels")).where("kept"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more): the least id.

    A row goes by its own text. Where an id repeats with several texts, one of
    them (by hash) stands under the id and the others, like rows without an id,
    under numbers beyond all ids, so that an id is kept before them. Rows equal
    in id and text stay once, as the least of them.
    """
    base = scratch(spark)
    held, unpacked = _packed(docs)
    text = F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    again = held.groupBy("doc_id").agg(F.min(text).alias("__first"), F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").drop("n")
    again = stored(again, f"{base}/again")
    plain = again.isEmpty()
    rows = held.withColumn("__row", F.col("doc_id"))
    if not plain:
        beyond = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(BEYOND_IDS - 1)) + F.lit(BEYOND_IDS)
        own = F.col("doc_id").isNotNull() & (F.col("__first").isNull() | (F.col("__first") == text))
        rows = held.join(again, "doc_id", "left").withColumn("__row", F.when(own, F.col("doc_id")).otherwise(beyond)).drop("__first")
    found = stored(near_duplicates(rows, id_col="__row", k=5), f"{base}/found")
    others = stored(found.where("__row <> component_id").select("__row").distinct(), f"{base}/others")
    kept = rows.join(others, "__row", "left_anti")
    if not plain:
        twice = stored(found.groupBy("__row").count().where("count > 1").select("__row"), f"{base}/twice")
        least = kept.join(twice, "__row", "left_semi").groupBy("__row").agg(F.min(F.struct(*held.columns)).alias("r")).select("r.*")
        kept = kept.join(twice, "__row", "left_anti").select(held.columns).union(least)
    return unpacked(kept)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a window of words with the benchmark. Of rows that repeat an id, or have none, each goes by its own text."""
    held, unpacked = _packed(docs)
    # nulls inside a struct equal each other
    held = held.withColumn("__row", F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")))
    hits = decontaminate(held, read_table(spark, sf_dir, "benchmark"), id_col="__row")
    hits = stored(hits.where("contaminated").select("__row").distinct(), f"{scratch(spark)}/hits")
    return unpacked(held.join(hits, "__row", "left_anti"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates under the session's tracewright.surrogate.key, a test key where that is unset; n_chars follows the text."""
    held, unpacked = _packed(docs)
    return unpacked(surrogates(held, spark.conf.get("tracewright.surrogate.key", TEST_KEY)).withColumn("n_chars", F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its bin."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Signatures, surrogates and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{i}-{name}")
    return docs
