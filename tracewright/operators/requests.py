"""Requests as rows: the bounds of searches and archive lists as columns, by the rules of ``search.validate`` and ``archive_queries.validate``.

A column of failures judges any number of logged or replayed requests in one
projection; a null failure is a request that may run. A null field is one that
was not given, an explicitly empty one is bad.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_printable, is_text, tokens
from . import archive_queries, search


def _any(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks)


def _bad_text(c: str, most: int = 128) -> Column:
    return F.col(c).isNotNull() & ~F.coalesce(is_text(F.col(c), most), F.lit(False))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _bad_range(days: int, low: int | None = None, high: int | None = None) -> Column:
    """One end alone, ends in the wrong order or too far apart, or beyond the bounds."""
    a, b = F.col("time_from"), F.col("time_to")
    outside = (a < low) | (b > high) if low is not None else F.lit(False)
    return (a.isNull() != b.isNull()) | F.coalesce((b < a) | (b - a > days * search.DAY_MS) | outside, F.lit(False))


def search_failures(requests: DataFrame, guarded: bool = True) -> DataFrame:
    """requests (keywords, the seven text filters, levels, time_from, time_to, offset, page_size) with ``failure``: the first rule that a request breaks."""
    levels, words = F.coalesce("levels", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>"))
    bad_word = lambda k: ~F.coalesce(is_text(k, search.KEYWORD_BYTES), F.lit(False)) | (F.size(F.coalesce(tokens(k), F.array().cast("array<string>"))) == 0)
    selective = _any([_given(c) for c in ("device_id", "work_order", "product_sn", "error_code")]) | F.col("time_from").isNotNull()
    page = (F.col("offset") >= 0) & F.col("page_size").between(1, search.MAX_PAGE) & (F.col("offset") + F.col("page_size") <= search.MAX_DEPTH)
    failure = F.coalesce(
        *[F.when(_bad_text(c), f"bad {c}") for c in search.TEXT_FILTERS],
        F.when((F.size(levels) > 3) | F.exists(levels, lambda x: ~F.coalesce(x.isin(*search.QUERY_LEVELS), F.lit(False))), "bad levels"),
        F.when(F.col("time_from").isNull() != F.col("time_to").isNull(), "a time range has two ends"),
        F.when(_bad_range(31, *search.TIME_BOUNDS), "bad time range"),
        F.when((F.size(words) > search.MAX_KEYWORDS) | F.exists(words, bad_word), "bad keywords"),
        F.when(~selective & F.lit(guarded), "a selective filter is required"),
        F.when(~F.coalesce(page, F.lit(False)), "page out of bounds"),
    )
    return requests.withColumn("failure", failure)


def archive_failures(requests: DataFrame) -> DataFrame:
    """requests (the six filters, time_from, time_to, page_size or null for the default) with ``failure`` and the page size that holds."""
    size = F.coalesce("page_size", F.lit(archive_queries.DEFAULT_PAGE))
    bad = lambda c: F.col(c).isNotNull() & ~F.coalesce(is_printable(F.col(c), 128), F.lit(False))
    failure = F.coalesce(
        *[F.when(bad(c), f"bad {c}") for c in archive_queries.FILTERS],
        F.when(_bad_range(archive_queries.MAX_RANGE_DAYS), "bad time range"),
        F.when(~(_given("work_order") | _given("product_sn") | F.col("time_from").isNotNull()), "a selective filter is required"),
        F.when(~size.between(1, archive_queries.MAX_PAGE), "bad page size"),
    )
    return requests.withColumns({"failure": failure, "page_size": size})
