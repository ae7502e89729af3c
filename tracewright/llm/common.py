"""Shared column expressions and the scratch store of the llm operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
#: ASCII characters that are no part of an alphanumeric word once A-Z are lower-cased.
BREAK_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, even where a lambda uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` agrees with that on pure ASCII and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, edge: str, run: str) -> Column:
    """Pieces between runs of break characters, without empty ones; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(edge))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, run)))


def white_words(text: Column) -> Column:
    return split_words(text, WHITE, WHITE_RUN)


def alnum_words(text: Column) -> Column:
    return split_words(ascii_lower(text), BREAKS, BREAK_RUN)


def window_hashes(words: Column, k: int) -> Column:
    """64-bit hash of each run of k words; empty where there are fewer. ``words`` must be bound (a lambda variable or a plain column)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def scratch(spark: SparkSession) -> str:
    """A fresh folder name in the folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/tracewright-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df once and reads it again: later steps don't recompute it, and it outlives executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
