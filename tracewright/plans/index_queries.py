"""Queries through the log index: events written as log files, scanned by byte ranges, parsed, built, merged and searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, search, state
from .catalogue import entry
from .roles import LOG_SQL, TOKENS_SQL
from .stored import logs

#: Lines of the devices' files; the file of DEV-17 has one more.
LINES_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY doc_id) AS line_no, 1 + split_part(device_id, '-', 2)::BIGINT AS archive_id FROM (
  SELECT doc_id, device_id, occurred_at_ms, level, module_name, error_code, strftime(make_timestamp(occurred_at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || ' level=' || level || ' module=' || module_name || ' device=' || device_id || ' code=' || CASE WHEN error_code = '' THEN '-' ELSE error_code END AS text FROM {LOG_SQL}
  UNION ALL SELECT DISTINCT 4611686018427387904, 'DEV-17', NULL::BIGINT, NULL, NULL, NULL, 'no  log line' FROM {LOG_SQL} WHERE device_id = 'DEV-17'))"""
_OFFSET = "coalesce(sum(strlen(text) + 1) OVER (PARTITION BY device_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset"
DOCS_SQL = f"(SELECT *, {_OFFSET}, strlen(text)::BIGINT AS byte_length FROM {LINES_SQL} WHERE device_id NOT IN ('DEV-7', 'DEV-11', 'DEV-13', 'DEV-17'))"


@entry(f"SELECT archive_id, line_no, {_OFFSET}, strlen(text)::BIGINT AS byte_length, sha256(text) AS digest FROM {LINES_SQL}")
def file_lines(spark, sf):
    """All lines of all files by byte ranges."""
    x = logs(spark, sf)
    scan = x.files.scan([r["relative_path"] for r in x.archives.select("relative_path").collect()], f"{x.index.root}/lines")
    return scan.lines().join(x.archives.select("relative_path", "archive_id"), "relative_path").select("archive_id", "line_no", "byte_offset", "byte_length", F.sha2("raw", 256).alias("digest"))


@entry(f"SELECT archive_id, strlen(string_agg(text, chr(10) ORDER BY line_no)) + 1 AS length, sha256(string_agg(text, chr(10) ORDER BY line_no) || chr(10)) AS sha256 FROM {LINES_SQL} GROUP BY archive_id")
def file_digests(spark, sf):
    """Sizes and digests of all files, from the lines that are read."""
    x = logs(spark, sf)
    scan = x.files.scan([r["relative_path"] for r in x.archives.select("relative_path").collect()], f"{x.index.root}/digests", keep_raw=False)
    return scan.digests().join(x.archives.select("relative_path", "archive_id"), "relative_path").select("archive_id", "length", "sha256")


@entry(f"SELECT archive_id, line_no, byte_offset, byte_length, occurred_at_ms, level, module_name, error_code, device_id, len({TOKENS_SQL})::BIGINT AS term_count FROM {DOCS_SQL}")
def index_documents(spark, sf):
    return logs(spark, sf).index.engine().docs.select("archive_id", "line_no", "byte_offset", "byte_length", "occurred_at_ms", "level", "module_name", "error_code", "device_id", "term_count")


@entry(f"""SELECT archive_id, CASE WHEN archive_id IN (8, 12, 14, 18) THEN 'FAILED' ELSE 'INDEXED' END AS state, CASE archive_id WHEN 8 THEN 'PARSER_PROFILE_NOT_FOUND' WHEN 12 THEN 'ARCHIVE_SHA256_MISMATCH' WHEN 14 THEN 'ARCHIVE_SIZE_MISMATCH' WHEN 18 THEN 'RUNTIME_LOG_TIME_INVALID' END AS failure_code,
  CASE WHEN archive_id = 18 THEN count(*) END AS failure_line, CASE WHEN archive_id IN (8, 12, 14, 18) THEN 0 ELSE count(*) END AS document_count FROM {LINES_SQL} GROUP BY archive_id""")
def index_archives(spark, sf):
    """States of the archives: four files fail, each for its own reason."""
    return logs(spark, sf).index.tables()[1].select("archive_id", "state", "failure_code", "failure_line", "document_count")


@entry(f"SELECT state, count(*) AS count FROM (SELECT DISTINCT archive_id, CASE WHEN archive_id IN (8, 12, 14, 18) THEN 'FAILED' ELSE 'INDEXED' END AS state FROM {LINES_SQL}) GROUP BY state")
def index_states(spark, sf):
    return state.state_counts(logs(spark, sf).index.tables()[1])


_TERMS = ("e3", "error")
_INDEX_BM25 = f"""(WITH d AS MATERIALIZED (SELECT *, {TOKENS_SQL} AS w FROM {DOCS_SQL}), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
  p AS (SELECT archive_id, line_no, occurred_at_ms, level, device_id, len(w) AS dl, unnest({list(_TERMS)}) AS term, w FROM d),
  q AS (SELECT * EXCLUDE w, len(list_filter(w, lambda x: x = term)) AS tf FROM p), f AS (SELECT term, count(*) AS df FROM q WHERE tf > 0 GROUP BY term)
  SELECT archive_id, line_no, occurred_at_ms, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY term) + CASE any_value(level) WHEN 'ERROR' THEN 2.0 WHEN 'WARN' THEN 1.0 ELSE 0.0 END AS score
  FROM q JOIN f USING (term), s WHERE tf > 0 AND device_id = 'DEV-3' GROUP BY archive_id, line_no, occurred_at_ms HAVING count(*) = {len(_TERMS)})"""


@entry(f"SELECT archive_id, line_no, round(score, 8) AS score, (SELECT count(*) FROM {_INDEX_BM25}) AS total_hits FROM {_INDEX_BM25} ORDER BY round(score, 10) DESC, occurred_at_ms DESC, archive_id DESC, line_no DESC LIMIT 20 OFFSET 2")
def index_search(spark, sf):
    """A page of a merged index by its block-max postings, filtered by a device, and the number of all hits."""
    page = logs(spark, sf).index.engine().search(search.SearchQuery(["Error", "E3"], device_id="DEV-3", offset=2, page_size=20))
    return page.items.select("archive_id", "line_no", F.round("score", 8).alias("score"), F.lit(page.total_hits).cast("long").alias("total_hits"))


@entry(f"SELECT archive_id, line_no, text AS raw, level, nullif(error_code, '') AS error_code FROM {DOCS_SQL} WHERE level = 'ERROR' AND error_code = 'E4' ORDER BY occurred_at_ms DESC, archive_id DESC, line_no DESC LIMIT 5")
def index_details(spark, sf):
    """The five best documents of an error code, each record read from its place in its file."""
    x = logs(spark, sf)
    e, files = x.index.engine(), x.index.files()
    best = e.error_code("E4", spark.range(1).select(F.lit("E4").alias("error_code"), F.lit(True).alias("enabled")))[1]
    out = None
    for r in best.items.select("doc_id").collect():
        d = e.detail(r["doc_id"], files, x.files)
        shown = search.detail_fields(d).join(d.select("line_no"), how="cross").select("archive_id", "line_no", "raw", "level", "error_code")
        out = shown if out is None else out.union(shown)
    return out if out is not None else e.docs.limit(0).select("archive_id", "line_no", F.lit("").alias("raw"), "level", "error_code")


@entry(f"WITH n AS (SELECT count(*) AS n FROM {DOCS_SQL} WHERE list_contains({TOKENS_SQL}, 'error')) SELECT unnest(['length_differs', 'term_frequency']) AS rule, n FROM n WHERE n > 0")
def index_rules(spark, sf):
    """The invariants of the segments, over postings of which one term's counts are put to nothing: two rules see each of them, the others hold."""
    x = logs(spark, sf).index
    t = {n: index.load(spark, x.root, n, [s["name"] for s in x.head()["segments"]]) for n in index.TABLES}
    posts = t["postings"].withColumn("tf", F.when(F.col("term") == "error", 0).otherwise(F.col("tf")))
    # one row for the statistics and a dictionary that begins anew where there are several segments
    stats = t["stats"].agg(F.sum("documents").alias("documents"), F.sum("total_terms").alias("total_terms"), (F.sum("total_terms") / F.sum("documents")).alias("average_length"), F.min("min_occurred_at_ms").alias("min_occurred_at_ms"), F.max("max_occurred_at_ms").alias("max_occurred_at_ms"))
    return index.violations(t["documents"], t["files"], posts, index.term_dictionary(t["postings"]), stats, merged=True)


@entry(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT archive_id, line_no, unnest({TOKENS_SQL}) AS term FROM {DOCS_SQL}) GROUP BY term")
def index_terms(spark, sf):
    """Document frequencies over all segments, by the counts of the blocks."""
    return logs(spark, sf).index.engine().blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"))


@entry("SELECT NULL::VARCHAR AS segment, NULL::VARCHAR AS file, NULL::VARCHAR AS problem FROM events WHERE false")
def index_audit(spark, sf):
    """Every file of every segment against its manifest; nothing is damaged."""
    return logs(spark, sf).index.audit()
