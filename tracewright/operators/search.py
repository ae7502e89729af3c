"""Keyword search over the index: AND of terms, filters, BM25 with business weights, top-K pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ms_to_iso, tokens, tokens_of
from ..sources.files import Archive, read_record
from . import blocks as block_max
from .blocks import idf, term_score

MAX_PAGE, MAX_DEPTH, MAX_KEYWORDS, KEYWORD_BYTES = 200, 1000, 8, 64
DAY_MS = 86_400_000
TIME_BOUNDS = (946_684_800_000, 4_102_444_800_000)
QUERY_LEVELS = ("INFO", "WARN", "ERROR")
TEXT_FILTERS = ("line_id", "station_id", "device_id", "work_order", "product_sn", "module_name", "error_code")


class InvalidQuery(ValueError):
    """INVALID_ARGUMENT."""


@dataclass
class SearchQuery:
    keywords: list[str] = field(default_factory=list)
    line_id: str | None = None
    station_id: str | None = None
    device_id: str | None = None
    work_order: str | None = None
    product_sn: str | None = None
    module_name: str | None = None
    error_code: str | None = None
    levels: list[str] = field(default_factory=list)
    time_from: int | None = None
    time_to: int | None = None
    anomaly_only: bool = False
    offset: int = 0
    page_size: int = 50

    @property
    def terms(self) -> list[str]:
        return sorted({t for k in self.keywords for t in tokens_of(k)})


def valid_text(value: str, most: int = 128) -> bool:
    return 0 < len(value.encode()) <= most and not re.search(r"[\x00-\x1f\x7f]", value)


def check_page(offset: int, page_size: int) -> None:
    """Python integers do not wrap, so huge offsets are rejected."""
    if not (offset >= 0 and 1 <= page_size <= MAX_PAGE and offset + page_size <= MAX_DEPTH):
        raise InvalidQuery("page out of bounds")


def validate(q: SearchQuery, guarded: bool = True) -> SearchQuery:
    """Bounds of texts, levels, times, keywords and pages, and the selectivity guard; an explicitly empty filter is an error."""
    for name in TEXT_FILTERS:
        value = getattr(q, name)
        if value is not None and not valid_text(value):
            raise InvalidQuery(f"bad {name}")
    if len(q.levels) > 3 or any(x not in QUERY_LEVELS for x in q.levels):
        raise InvalidQuery("bad levels")
    if (q.time_from is None) != (q.time_to is None):
        raise InvalidQuery("a time range has two ends")
    if q.time_from is not None and not (TIME_BOUNDS[0] <= q.time_from <= q.time_to <= TIME_BOUNDS[1] and q.time_to - q.time_from <= 31 * DAY_MS):
        raise InvalidQuery("bad time range")
    if len(q.keywords) > MAX_KEYWORDS or any(not valid_text(k, KEYWORD_BYTES) or not tokens_of(k) for k in q.keywords):
        raise InvalidQuery("bad keywords")
    if guarded and not (q.device_id or q.work_order or q.product_sn or q.error_code or q.time_from is not None):
        raise InvalidQuery("a selective filter is required")
    check_page(q.offset, q.page_size)
    return q


def anomaly() -> Column:
    return F.coalesce(F.col("level").isin("WARN", "ERROR") | (F.coalesce("error_code", F.lit("")) != ""), F.lit(False))


def filters(docs: DataFrame, q: SearchQuery) -> DataFrame:
    for name in TEXT_FILTERS:
        if getattr(q, name) is not None:
            docs = docs.where(F.col(name) == getattr(q, name))
    if q.levels:
        docs = docs.where(F.col("level").isin(*q.levels))
    if q.time_from is not None:
        docs = docs.where(F.col("occurred_at_ms").between(q.time_from, q.time_to))
    return docs.where(anomaly()) if q.anomaly_only else docs


def business_weight(q: SearchQuery) -> Column:
    out = F.when(F.col("level") == "ERROR", 2.0).when(F.col("level") == "WARN", 1.0).otherwise(0.0)
    if q.error_code is not None:
        out = out + F.when(F.col("error_code") == q.error_code, 3.0).otherwise(0.0)
    if q.module_name is not None:
        out = out + F.when(F.col("module_name") == q.module_name, 1.5).otherwise(0.0)
    return out


def bm25(docs: DataFrame, posts: DataFrame, terms: list[str], n: int, average: float, df: dict[str, int], key: str = "doc_id", length: str = "term_count") -> DataFrame:
    """(key, bm25) of the documents that hold every term. Statistics are the corpus's, never the filtered set's.

    Postings are cut to the query's terms at the scan and pivoted into one
    column a term, so that scores are summed in term order, whatever the plan.
    """
    if not terms or any(t not in df for t in terms):
        return docs.select(key, F.lit(0.0).alias("bm25")).limit(0) if terms else docs.select(key, F.lit(0.0).alias("bm25"))
    tf = posts.where(F.col("term").isin(*terms)).groupBy(key).agg(*[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"__tf{i}") for i, t in enumerate(terms)])
    hit = tf.where(" AND ".join(f"__tf{i} IS NOT NULL" for i in range(len(terms)))).join(docs.select(key, length), key)
    score = sum((term_score(F.col(f"__tf{i}"), F.col(length), idf(n, df[t]), average) for i, t in enumerate(terms)), F.lit(0.0))
    return hit.select(key, score.alias("bm25"))


def scan_scores(docs: DataFrame, terms: list[str], text: str = "text", keep: Column | None = None) -> DataFrame:
    """docs and bm25 of those that hold every term, without an index: two narrow passes over the texts.

    Term counts are taken inside the row. The first pass aggregates the corpus
    statistics of all docs to one row, the second scores; ``keep`` narrows the
    second alone.
    """
    words = docs.withColumn("__w", tokens(F.col(text)))
    counts = [F.size(F.filter("__w", _is(t))).cast("long").alias(f"__tf{i}") for i, t in enumerate(terms)]
    d = words.select(*docs.columns, F.size("__w").cast("long").alias("__len"), *counts)
    s = d.agg(F.count("*").alias("n"), F.coalesce(F.avg("__len"), F.lit(1.0)).alias("avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    for i in range(len(terms)):
        d = d.where(F.col(f"__tf{i}") > 0)
    score = sum((term_score(F.col(f"__tf{i}"), F.col("__len"), idf(s["n"], s[f"df{i}"]), s["avg"] or 1.0) for i in range(len(terms))), F.lit(0.0))
    return (d if keep is None else d.where(keep)).select(*docs.columns, score.alias("bm25"))


def _is(term: str):
    return lambda t: t == term


@dataclass
class Page:
    snapshot_version: int
    total_hits: int
    items: DataFrame


class SearchEngine:
    """One snapshot of the index: the READY batches as they were when it was opened."""

    def __init__(self, docs: DataFrame, posts: DataFrame, stats: DataFrame, terms: DataFrame, ready: list[int], blocks: DataFrame | None = None):
        self.docs, self.posts, self.terms, self.blocks = docs, posts, terms, blocks
        self.version = max(ready, default=0)
        s = stats.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_terms"), F.lit(0)).alias("t")).first()
        self.documents, self.average = s["n"], (s["t"] / s["n"] if s["n"] and s["t"] else 1.0)

    def hits(self, q: SearchQuery) -> DataFrame:
        """All filtered matches with their score."""
        found = filters(self.docs, q)
        terms = q.terms
        if terms:
            found = found.join(bm25(self.docs, self.posts, terms, self.documents, self.average, self._df(terms)), "doc_id")
        else:
            found = found.withColumn("bm25", F.lit(0.0))
        return found.withColumn("score", F.col("bm25") + business_weight(q))

    def _df(self, terms: list[str]) -> dict[str, int]:
        return {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()}

    def search(self, q: SearchQuery, guarded: bool = True) -> Page:
        """Ranked by score (to 10 digits), then time, then id, all falling: a top-K of offset + page rows, then the slice.

        With blocks only ranges of documents that can reach the page are scored,
        and hits are counted by their ids.
        """
        validate(q, guarded)
        if q.terms and self.blocks is not None:
            hits, total = self._by_blocks(q)
        else:
            hits = self.hits(q)
            total = hits.count()
        ranked = hits.orderBy(F.round("score", 10).desc(), F.desc("occurred_at_ms"), F.desc("doc_id")).offset(q.offset).limit(q.page_size)
        return Page(self.version, total, ranked)

    def _by_blocks(self, q: SearchQuery) -> tuple[DataFrame, int]:
        """Hits that hold the page, and the number of all."""
        found, weight = filters(self.docs, q), business_weight(q)
        most = 2.0 + 3.0 * (q.error_code is not None) + 1.5 * (q.module_name is not None)
        near = block_max.best(self.blocks, q.terms, self.documents, self.average, q.offset + q.page_size, self._df(q.terms), found.select("doc_id", weight.alias("__w")), F.col("__w"), most)
        whole = filters(self.docs, q) is self.docs
        total = block_max.count_hits(self.blocks, q.terms).first()[0] if whole else block_max.documents_with(self.blocks, q.terms).join(found.select("doc_id"), "doc_id").count()
        return found.join(near, "doc_id").withColumn("score", F.col("bm25") + weight), total

    def anomalies(self, q: SearchQuery) -> Page:
        q.keywords, q.anomaly_only = [], True
        return self.search(q)

    def detail(self, doc: int, files: DataFrame, archive: Archive | DataFrame | None = None) -> DataFrame:
        """The document and its file, found through the batch in the id's high bits; no row if unknown. With the archive also score 0.0, the record's bytes as ``raw``, and ``failure``."""
        row = self.docs.where((F.col("batch_id") == doc >> 32) & (F.col("doc_id") == doc)).join(files, ["batch_id", "archive_id"])
        if archive is None:
            return row
        r = row.first()
        if r is None:
            return row.select("*", F.lit(0.0).alias("score"), F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("failure"))
        raw = read_record(archive, r["relative_path"], r["file_size"], r["byte_offset"], r["byte_length"]).first()
        raw = raw or {"raw": None, "failure": "STORAGE_IO_ERROR"}
        return row.select("*", F.lit(0.0).alias("score"), F.lit(raw["raw"]).cast("binary").alias("raw"), F.lit(raw["failure"]).cast("string").alias("failure"))

    def error_code(self, code: str, catalog: DataFrame) -> tuple[DataFrame, Page]:
        """The enabled catalogue row and the five best documents of a code; the internal query needs no selective filter. LookupError for a code that is not in the catalogue."""
        row = catalog.where((F.col("error_code") == code) & F.col("enabled"))
        if row.isEmpty():
            raise LookupError("ERROR_CODE_NOT_FOUND")
        return row, self.search(SearchQuery(error_code=code, page_size=5), guarded=False)

    def restore(self, version: int, ids: list[int]) -> DataFrame:
        """Documents of a cached page in its order; a stale version or a missing id raises, and the caller recomputes."""
        if version != self.version:
            raise InvalidQuery("stale snapshot")
        spark = self.docs.sparkSession
        wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, doc_id long")
        check_page(0, max(1, len(ids)))
        rows = self.docs.join(F.broadcast(wanted), "doc_id").orderBy("pos")  # a page at most
        if rows.count() != len(ids):
            raise InvalidQuery("unknown document")
        return rows


def summary(hits: DataFrame) -> DataFrame:
    """The public fields of a hit: ISO times, and nulls for three fields that are empty."""
    null = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return hits.select(F.col("doc_id").cast("string").alias("doc_id"), ms_to_iso(F.col("occurred_at_ms")).alias("occurred_at"), ms_to_iso(F.col("archived_at_ms")).alias("archived_at"), "line_id", "station_id", "device_id", "collector_id", null("work_order"), null("product_sn"), "source_type", "level", "module_name", null("error_code"), F.coalesce("event_name", F.lit("")).alias("event_name"), "score")


def detail_fields(details: DataFrame) -> DataFrame:
    """The public fields of a detail: those of a hit, its archive and range, and the record as text."""
    return summary(details).join(details.select(F.col("doc_id").cast("string").alias("doc_id"), "archive_id", "byte_offset", "byte_length", F.col("raw").cast("string").alias("raw")), "doc_id")
