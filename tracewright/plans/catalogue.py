"""The query catalogue: every operator on the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive_queries, blocks, cache, index, parsers, replay, search, sessions, state
from ..sources import archives as archive_source
from ..sources.files import lines
from .roles import ARCHIVES_SQL, LOG_SQL, POSTINGS_SQL, TEXTS_SQL, archives, log, table, texts
from .stored import shared_dir, text_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def entry(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TERMS = ["of", "the"]


def _bm25_sql(terms: list[str] = TERMS, where: str = "true") -> str:
    terms = sorted(terms)
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""(WITH d AS {TEXTS_SQL}, p AS {POSTINGS_SQL},
  s AS (SELECT count(*) AS n, avg(term_count) AS avgdl FROM d),
  f AS (SELECT term, count(*) AS df FROM p WHERE term IN ({names}) GROUP BY term),
  x AS (SELECT p.doc_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * term_count / avgdl)) AS part
        FROM p JOIN f USING (term) JOIN d USING (doc_id), s WHERE {where})
  SELECT doc_id, sum(part ORDER BY term) AS bm25 FROM x GROUP BY doc_id HAVING count(*) = {len(terms)})"""


@entry(f"SELECT doc_id, round(bm25, 8) AS score FROM {_bm25_sql()} ORDER BY round(bm25, 10) DESC, doc_id DESC LIMIT 10")
def bm25_topk(spark, sf):
    """The flagship: the best ten documents that hold every term."""
    best = text_index(spark, sf).best(TERMS, 10)
    return best.orderBy(F.round("bm25", 10).desc(), F.desc("doc_id")).limit(10).select("doc_id", F.round("bm25", 8).alias("score"))


@entry(f"SELECT doc_id, round(bm25, 8) AS score FROM {_bm25_sql()} ORDER BY round(bm25, 10) DESC, doc_id DESC LIMIT 10 OFFSET 10")
def bm25_page2(spark, sf):
    best = text_index(spark, sf).best(TERMS, 20)
    return best.orderBy(F.round("bm25", 10).desc(), F.desc("doc_id")).offset(10).limit(10).select("doc_id", F.round("bm25", 8).alias("score"))


@entry(f"SELECT doc_id, round(bm25, 8) AS score FROM {_bm25_sql(where=chr(34) + 'lang' + chr(34) + ' = ' + chr(39) + 'en' + chr(39))}")
def bm25_filtered(spark, sf):
    """A filter narrows the documents, never the statistics."""
    x = text_index(spark, sf)
    return x.docs.where("lang = 'en'").select("doc_id").join(x.scores(TERMS), "doc_id").select("doc_id", F.round("bm25", 8).alias("score"))


@entry(f"SELECT doc_id, round(bm25 + CASE WHEN quality = 0 THEN 2.0 ELSE 0.0 END + CASE WHEN source = 'src1' THEN 1.5 ELSE 0.0 END, 8) AS score FROM {_bm25_sql()} JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)")
def weighted_search(spark, sf):
    """Scores with business weights: a bad label plays the level, the source the module."""
    x = text_index(spark, sf)
    d = x.docs.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality") == 0, "ERROR").otherwise("INFO").alias("level"), F.col("source").alias("module_name"))
    w = search.business_weight(search.SearchQuery(module_name="src1"))
    return x.scores(TERMS).join(d, "doc_id").select("doc_id", F.round(F.col("bm25") + w, 8).alias("score"))


@entry(f"SELECT doc_id, round(bm25, 8) AS score FROM {_bm25_sql(['of', 'that', 'the'])}")
def bm25_index(spark, sf):
    """The same by the inverted index: postings, dictionary and statistics."""
    d, terms = texts(spark, sf), ["of", "that", "the"]
    posts = index.postings(d).where(F.col("term").isin(*terms))
    s = index.corpus_stats(d).first()
    df = {r["term"]: r["df"] for r in posts.groupBy("term").agg(F.count("*").alias("df")).collect()}
    return search.bm25(d, posts, terms, s["documents"], s["average_length"], df).select("doc_id", F.round("bm25", 8).alias("score"))


@entry(f"SELECT count(*) AS total_hits FROM {_bm25_sql()}")
def total_hits(spark, sf):
    return blocks.count_hits(text_index(spark, sf).blocks, TERMS)


@entry(f"SELECT doc_id, term_count FROM {TEXTS_SQL}")
def tokenize_counts(spark, sf):
    return texts(spark, sf).select("doc_id", "term_count")


@entry(f"SELECT term, doc_id, tf FROM {POSTINGS_SQL}")
def term_frequency(spark, sf):
    return index.postings(texts(spark, sf))


@entry(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {POSTINGS_SQL} GROUP BY term")
def document_frequency(spark, sf):
    return index.postings(texts(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@entry(f"SELECT count(*) AS documents, sum(term_count)::BIGINT AS total_terms, round(avg(term_count), 9) AS average_length FROM {TEXTS_SQL}")
def corpus_stats(spark, sf):
    return index.corpus_stats(texts(spark, sf)).withColumn("average_length", F.round("average_length", 9))


@entry(f"SELECT term, df, (sum(df) OVER (ORDER BY term) - df)::BIGINT AS posting_begin, df AS posting_count FROM (SELECT term, count(*) AS df FROM {POSTINGS_SQL} GROUP BY term)")
def term_dictionary(spark, sf):
    return index.term_dictionary(index.postings(texts(spark, sf)))


@entry(f"SELECT doc_id FROM {POSTINGS_SQL} WHERE term IN ('of', 'the') GROUP BY doc_id HAVING count(*) = 2")
def keyword_and(spark, sf):
    return text_index(spark, sf).with_all(TERMS)


@entry(f"SELECT doc_id FROM {POSTINGS_SQL} WHERE term = 'of' INTERSECT SELECT doc_id FROM {POSTINGS_SQL} WHERE term = 'and'")
def posting_intersection(spark, sf):
    return text_index(spark, sf).with_all(["of", "and"])


_ANOMALY = "(level IN ('WARN', 'ERROR') OR error_code <> '')"
_WEIGHT = "CASE level WHEN 'ERROR' THEN 2.0 WHEN 'WARN' THEN 1.0 ELSE 0.0 END"


@entry(f"SELECT doc_id, level, error_code, {_WEIGHT}::DOUBLE AS score FROM {LOG_SQL} WHERE {_ANOMALY} ORDER BY score DESC, occurred_at_ms DESC, doc_id DESC LIMIT 100")
def anomaly_list(spark, sf):
    q = search.SearchQuery(anomaly_only=True, page_size=100)
    hits = search.filters(log(spark, sf), q).withColumn("score", search.business_weight(q))
    return hits.orderBy(F.desc("score"), F.desc("occurred_at_ms"), F.desc("doc_id")).limit(100).select("doc_id", "level", "error_code", "score")


@entry("SELECT l_orderkey * 8 + l_linenumber AS doc_id, l_partkey AS module FROM lineitem WHERE l_quantity = 50 ORDER BY l_shipdate DESC, l_orderkey * 8 + l_linenumber DESC, l_partkey DESC LIMIT 100")
def anomaly_lines(spark, sf):
    """The load test's list over all order lines: one in fifty is an ERROR, the newest hundred come first."""
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("doc_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("occurred_at_ms"), F.when(F.col("l_quantity") == 50, "ERROR").otherwise("INFO").alias("level"), F.lit("").alias("error_code"), F.col("l_partkey").alias("module"))
    q = search.SearchQuery(anomaly_only=True, page_size=100)
    return search.filters(d, q).withColumn("score", search.business_weight(q)).orderBy(F.desc("score"), F.desc("occurred_at_ms"), F.desc("doc_id"), F.desc("module")).limit(100).select("doc_id", "module")


@entry(f"SELECT doc_id, level, occurred_at_ms FROM {LOG_SQL} WHERE level IN ('WARN', 'ERROR') AND occurred_at_ms BETWEEN (SELECT min(occurred_at_ms) + 3600000 FROM {LOG_SQL}) AND (SELECT min(occurred_at_ms) + 7200000000 FROM {LOG_SQL})")
def level_in_time_range(spark, sf):
    d = log(spark, sf)
    low = d.agg(F.min("occurred_at_ms")).first()[0] or 0
    return search.filters(d, search.SearchQuery(levels=["WARN", "ERROR"], time_from=low + 3_600_000, time_to=low + 7_200_000_000)).select("doc_id", "level", "occurred_at_ms")


@entry(f"SELECT doc_id, round(2.0 + 3.0, 1)::DOUBLE AS score FROM {LOG_SQL} WHERE error_code = 'E3' ORDER BY occurred_at_ms DESC, doc_id DESC LIMIT 5")
def error_code_matches(spark, sf):
    q = search.SearchQuery(error_code="E3", page_size=5)
    hits = search.filters(log(spark, sf), q).withColumn("score", search.business_weight(q))
    return hits.orderBy(F.desc("score"), F.desc("occurred_at_ms"), F.desc("doc_id")).limit(5).select("doc_id", "score")


@entry(f"SELECT doc_id, strftime(make_timestamp(occurred_at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at, nullif(error_code, '') AS error_code, module_name FROM {LOG_SQL}")
def log_summary(spark, sf):
    none = {c: F.lit("") for c in ("line_id", "station_id", "collector_id", "work_order", "product_sn", "source_type", "event_name")}
    hits = log(spark, sf).withColumns(none | {"archived_at_ms": F.col("occurred_at_ms"), "score": F.lit(0.0)})
    return search.summary(hits).select(F.col("doc_id").cast("long").alias("doc_id"), "occurred_at", "error_code", "module_name")


_FIRST = f"SELECT archive_id, archived_at_ms FROM {ARCHIVES_SQL} WHERE work_order = 'WO-7' ORDER BY archived_at_ms DESC, archive_id DESC LIMIT 21"


@entry(_FIRST)
def archive_list(spark, sf):
    q = archive_queries.validate(archive_queries.ArchiveQuery(work_order="WO-7", page_size=20))
    return archive_queries.list_page(archives(spark, sf), q).select("archive_id", "archived_at_ms")


@entry(f"WITH f AS ({_FIRST}), c AS (SELECT * FROM f ORDER BY archived_at_ms DESC, archive_id DESC LIMIT 1 OFFSET 19) SELECT a.archive_id, a.archived_at_ms FROM {ARCHIVES_SQL} a, c WHERE work_order = 'WO-7' AND (a.archived_at_ms < c.archived_at_ms OR (a.archived_at_ms = c.archived_at_ms AND a.archive_id < c.archive_id)) ORDER BY a.archived_at_ms DESC, a.archive_id DESC LIMIT 21")
def archive_list_next(spark, sf):
    """The page after the first one's cursor."""
    a = archives(spark, sf)
    q = archive_queries.ArchiveQuery(work_order="WO-7", page_size=20)
    rows = archive_queries.list_page(a, q).select("archive_id", "archived_at_ms").collect()
    if len(rows) > 20:
        q.cursor = (rows[19]["archived_at_ms"], rows[19]["archive_id"])
    return archive_queries.list_page(a, q).select("archive_id", "archived_at_ms")


@entry(f"SELECT archive_id, file_type, result FROM {ARCHIVES_SQL} WHERE file_type = 'TEST_REPORT' AND device_id = 'DEV-3' AND archived_at_ms BETWEEN 820454400000 AND 852076800000")
def archive_filter(spark, sf):
    q = archive_queries.ArchiveQuery(file_type="TEST_REPORT", device_id="DEV-3", time_from=820454400000, time_to=852076800000)
    return archive_queries.matching(archives(spark, sf), q).select("archive_id", "file_type", "result")


@entry(f"SELECT archive_id, device_id, file_size FROM {ARCHIVES_SQL} WHERE archive_id = 33")
def archive_lookup(spark, sf):
    return archive_source.lookup(archives(spark, sf), archive_id=33).select("archive_id", "device_id", "file_size")


_CURSOR = "rtrim(translate(to_base64(unhex(lpad(to_hex(archived_at_ms), 16, '0') || lpad(to_hex(archive_id), 16, '0'))), '+/', '-_'), '=')"


@entry(f"SELECT archive_id, {_CURSOR} AS cursor FROM {ARCHIVES_SQL} WHERE archived_at_ms > 0 AND archive_id > 0")
def cursor_encode(spark, sf):
    a = archives(spark, sf).where("archived_at_ms > 0 AND archive_id > 0")
    return a.select("archive_id", S.cursor_encode(F.col("archived_at_ms"), F.col("archive_id")).alias("cursor"))


@entry(f"SELECT archive_id AS id, archived_at_ms AS ms FROM {ARCHIVES_SQL} WHERE archived_at_ms > 0 AND archive_id > 0")
def cursor_decode(spark, sf):
    return cursor_encode(spark, sf).select(S.cursor_decode(F.col("cursor")).alias("c")).select("c.id", "c.ms")


@entry(f"SELECT doc_id, strftime(make_timestamp(occurred_at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(make_timestamp(occurred_at_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS stamp FROM {LOG_SQL}")
def iso_format(spark, sf):
    return log(spark, sf).select("doc_id", S.ms_to_iso(F.col("occurred_at_ms")).alias("iso"), S.ms_to_datetime(F.col("occurred_at_ms")).alias("stamp"))


@entry(f"SELECT doc_id, occurred_at_ms AS ms FROM {LOG_SQL}")
def iso_parse(spark, sf):
    return log(spark, sf).select("doc_id", S.iso_to_ms(S.ms_to_iso(F.col("occurred_at_ms"))).alias("ms"))


@entry("SELECT c_custkey AS device_id, n_name AS station_id, r_name AS line_id, c_acctbal > 0 AND n_nationkey <> 3 AND r_regionkey <> 2 AS all_enabled FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def device_identity(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    devices = c.select(F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("station_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    stations = n.select(F.col("n_nationkey").alias("station_id"), F.col("n_regionkey").alias("line_id"), F.col("n_name").alias("station_type"), (F.col("n_nationkey") != 3).alias("enabled"))
    lines_ = r.select(F.col("r_regionkey").alias("line_id"), F.col("r_name").alias("line_name"), (F.col("r_regionkey") != 2).alias("enabled"))
    found = archive_queries.device_identity(devices, stations, lines_).join(lines_.select("line_id", "line_name"), "line_id")
    return found.select("device_id", F.col("station_type").alias("station_id"), F.col("line_name").alias("line_id"), "all_enabled")


@entry("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def binding_semi(spark, sf):
    pairs = table(spark, sf, "documents").select("doc_id", "source", F.col("doc_id").alias("device_id"), F.lit("C").alias("collector_id"))
    bindings = table(spark, sf, "labels").select(F.col("doc_id").alias("device_id"), F.lit("C").alias("collector_id"), (F.col("quality") == 1).alias("enabled"))
    return archive_queries.authorised(pairs, bindings).select("doc_id", "source")


@entry("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_anti(spark, sf):
    return archive_queries.orphans(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@entry("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'PARSER_PROFILE_NOT_FOUND' END AS failure_code FROM documents d LEFT JOIN labels l USING (doc_id)")
def profile_left(spark, sf):
    p = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("p"))
    return table(spark, sf, "documents").join(p, "doc_id", "left").select("doc_id", F.when(F.col("p").isNull(), "PARSER_PROFILE_NOT_FOUND").alias("failure_code"))


@entry(f"SELECT coalesce(max(archive_id), 0)::BIGINT AS high_water_mark FROM {ARCHIVES_SQL}")
def high_water_mark(spark, sf):
    return archive_source.high_water_mark(archives(spark, sf))


@entry(f"SELECT archive_id, file_type FROM {ARCHIVES_SQL} WHERE archive_id > 500 AND file_type IN ('RUNTIME_LOG', 'TEST_REPORT') ORDER BY archive_id LIMIT 100")
def incremental_scan(spark, sf):
    return archive_source.list_after(archives(spark, sf), 500, 100).select("archive_id", "file_type")


@entry(f"SELECT archive_id FROM {ARCHIVES_SQL} WHERE file_type IN ('RUNTIME_LOG', 'TEST_REPORT') AND archive_id % 3 <> 0 ORDER BY archive_id LIMIT 100")
def undiscovered_scan(spark, sf):
    a = archives(spark, sf)
    return archive_source.undiscovered(a, a.where("archive_id % 3 = 0"), 100).select("archive_id")


@entry(f"SELECT archive_id, file_size FROM {ARCHIVES_SQL} WHERE archive_id IN (SELECT archive_id FROM {ARCHIVES_SQL} WHERE file_type = 'RUNTIME_LOG' ORDER BY archive_id LIMIT 5)")
def find_by_ids(spark, sf):
    a = archives(spark, sf)
    ids = [r[0] for r in a.where("file_type = 'RUNTIME_LOG'").select("archive_id").orderBy("archive_id").limit(5).collect()]
    return archive_source.find_by_ids(a, ids).select("archive_id", "file_size")


@entry(f"SELECT state, count(*) AS count FROM {ARCHIVES_SQL} GROUP BY state")
def state_counts(spark, sf):
    return state.state_counts(archives(spark, sf))


@entry(f"SELECT count(*) AS source_files, count(*) FILTER (result IS NOT NULL) AS parsed_files, count(*) FILTER (result IS NULL) AS failed_files, sum(CASE WHEN result IS NOT NULL THEN file_size % 100 ELSE 0 END)::BIGINT AS documents FROM {ARCHIVES_SQL}")
def batch_summary(spark, sf):
    a = archives(spark, sf)
    n = F.col("file_size") % 100
    return parsers.batch_summary(a.select("archive_id", F.when(F.col("result").isNull(), "RUNTIME_LOG_EMPTY").alias("failure_code"), F.when(F.col("result").isNotNull(), n).otherwise(0).alias("document_count")))


@entry("WITH o AS (SELECT o_orderkey AS archive_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY archive_id) AS t FROM o) SELECT archive_id, n AS document_count FROM s WHERE t <= 300")
def batch_cutoff(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("archive_id")).agg(F.count("*").alias("document_count"))
    return parsers.cut_batch(o.withColumn("failure_code", F.lit(None).cast("string")), 300).select("archive_id", "document_count")


@entry("SELECT l_orderkey AS archive_id, l_linenumber::BIGINT AS line_no, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS local_id, (7::BIGINT << 32) | (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) AS doc_id FROM lineitem")
def doc_ids(spark, sf):
    """Positions in archive and line order, nulls last; lines of an equal number are ordered by part and supplier."""
    n = F.col("l_linenumber").cast("long")
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("archive_id"), n.alias("n"), F.struct(F.coalesce(n, F.lit(1 << 31)).alias("n"), "l_partkey", "l_suppkey").alias("line_no"))
    return index.assign_ids(d, 7).select("archive_id", F.col("n").alias("line_no"), "local_id", "doc_id")


@entry("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return state.upsert(old, new, "user_id", "at").select("user_id", "event_id", "event_type")


@entry(f"SELECT archive_id, CASE WHEN batch_id = 4 AND result IS NOT NULL THEN 'INDEXED' WHEN result IS NOT NULL THEN 'PARSED' ELSE 'FAILED' END AS state FROM {ARCHIVES_SQL}")
def publish_join_update(spark, sf):
    i = archives(spark, sf).select("archive_id", "batch_id", F.when(F.col("result").isNotNull(), "PARSED").otherwise("FAILED").alias("state"))
    b = spark.range(13).select(F.col("id").alias("batch_id"), F.when(F.col("id") == 4, "BUILDING").otherwise("PARSED").alias("state"))
    return state.publish_ready(b, i, 4)[1].select("archive_id", "state")


@entry("SELECT l_orderkey AS upload, list_sort(list_filter([0, 1, 2, 3, 4, 5, 6], lambda x: NOT list_contains(list(l_linenumber - 1), x)))::VARCHAR AS missing FROM lineitem GROUP BY l_orderkey")
def missing_chunks(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("upload")).agg(F.collect_set((F.col("l_linenumber") - 1).cast("long")).alias("done"))
    m = sessions.missing_chunks(F.col("done"), F.lit(7).cast("long"))
    return d.select("upload", F.concat(F.lit("["), F.array_join(F.array_sort(m), ", "), F.lit("]")).alias("missing"))


@entry("SELECT l_orderkey AS upload, count(DISTINCT l_linenumber) = 4 AS complete FROM lineitem GROUP BY l_orderkey")
def chunk_completeness(spark, sf):
    return sessions.completeness(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("number")), F.lit(4))


@entry("WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS size, 1000::BIGINT AS c FROM documents), n AS (SELECT *, (size + c - 1) // c AS k FROM d WHERE size > 0) SELECT doc_id, k AS chunks, i AS number, CASE WHEN i < k - 1 THEN c ELSE size - c * (k - 1) END AS length FROM n, LATERAL (SELECT unnest(range(k)) AS i)")
def chunk_lengths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.lit(1000).cast("long").alias("c")).withColumn("chunks", S.chunk_count(F.col("size"), F.col("c")).cast("long"))
    d = d.where("chunks > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("number"))
    return d.select("doc_id", "chunks", "number", S.chunk_length(F.col("size"), F.col("c"), F.col("number")).alias("length"))


@entry(f"SELECT CASE WHEN grouping(device_id) = 0 THEN device_id END AS device_id, CASE WHEN grouping(module_name) = 0 THEN module_name END AS collector_id, count(*) AS sessions, sum(doc_id)::BIGINT AS bytes FROM {LOG_SQL} GROUP BY GROUPING SETS ((), (device_id), (module_name))")
def session_quota(spark, sf):
    a = log(spark, sf).select("device_id", F.col("module_name").alias("collector_id"), F.col("doc_id").alias("file_size"))
    return sessions.quotas(a)


@entry("WITH e AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id AS device_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 90 SECOND AS online FROM e")
def heartbeat_online(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("work_order"))
    now = e.agg(F.max("ts")).first()[0]
    return sessions.heartbeats(e, F.lit(now)).select("device_id", "online")


@entry("""WITH e AS (SELECT user_id % 40 AS d, ts::TIMESTAMP AS ts FROM events), w AS (SELECT d, ts, lag(ts) OVER x AS b, lead(ts) OVER x AS a FROM e WINDOW x AS (PARTITION BY d ORDER BY ts))
SELECT d AS device_id, 'ONLINE' AS state, epoch_us(ts) AS at FROM w WHERE b IS NULL OR ts > b + INTERVAL 6 HOUR UNION ALL SELECT d, 'OFFLINE', epoch_us(ts + INTERVAL 6 HOUR) FROM w WHERE a IS NULL OR a > ts + INTERVAL 6 HOUR""")
def device_transitions(spark, sf):
    """When devices turn online and offline, with a lifetime of six hours."""
    e = table(spark, sf, "events").select((F.col("user_id") % 40).alias("device_id"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions.device_transitions(e, 21_600).select("device_id", "state", F.unix_micros("at").alias("at"))


@entry("""WITH e AS (SELECT user_id AS p, event_id AS n, event_type AS s, event_type IS DISTINCT FROM lag(event_type) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(c::INT) OVER (PARTITION BY p ORDER BY n) AS k FROM e),
r AS (SELECT p, n, row_number() OVER (PARTITION BY p, k ORDER BY n) AS i FROM g), b AS (SELECT *, lag(i) OVER (PARTITION BY p ORDER BY n) AS before FROM r)
SELECT p AS path, n AS scan_no, 'SEALED' AS event FROM b WHERE i = 2 UNION ALL SELECT p, n, 'CHANGED' FROM b WHERE i = 1 AND before >= 2""")
def seal_events(spark, sf):
    """Users' event types as sizes of a file: sealed by two equal ones, changed by another after that."""
    s = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("scan_no"), F.col("event_type").alias("size"), F.lit(0).alias("mtime"))
    return sessions.seal_events(s)


@entry("SELECT event_id, NOT first AS replayed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) = 1 AS first FROM events)")
def replay_dedup(spark, sf):
    """The window of one day makes request ids; a lifetime beyond it leaves the first of each."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("device_id"), F.concat("event_type", F.date_format("ts", "yyyyMMdd")).alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_s"))
    return replay.first_requests(e, 86_400_000_000_000, f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}").select("event_id", "replayed")


@entry("""WITH RECURSIVE e AS (SELECT event_id, user_id % 20 AS d, event_type AS r, epoch_us(ts) // 1000000 AS t FROM events),
k AS (SELECT d, r, t, row_number() OVER (PARTITION BY d, r ORDER BY t) AS i FROM (SELECT DISTINCT d, r, t FROM e)),
c AS (SELECT d, r, min(t) AS t FROM k GROUP BY d, r UNION ALL SELECT c.d, c.r, (SELECT min(k.t) FROM k WHERE k.d = c.d AND k.r = c.r AND k.t >= c.t + 21600) FROM c WHERE c.t IS NOT NULL),
a AS (SELECT min(event_id) AS event_id FROM e JOIN c USING (d, r, t) GROUP BY d, r, t)
SELECT event_id, event_id NOT IN (SELECT event_id FROM a) AS replayed FROM e""")
def replay_chains(spark, sf):
    """Few keys with long lives: each accepted request opens a window of six hours, and the next begins where that ends."""
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).cast("string").alias("device_id"), F.col("event_type").alias("request_id"), F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000).cast("long")).alias("ts_s"))
    return replay.first_requests(e, 21_600, f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}").select("event_id", "replayed")


@entry("WITH e AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(c::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e) SELECT event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id)::BIGINT AS stable_count, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) >= 2 AS sealed FROM g")
def stable_window(spark, sf):
    s = table(spark, sf, "events").select("event_id", F.col("user_id").alias("path"), F.col("event_id").alias("scan_no"), F.col("event_type").alias("size"), F.lit(0).alias("mtime"), F.lit(False).alias("has_marker"), F.lit(True).alias("has_sidecar"))
    return sessions.sealed(s, "STABLE_WINDOW").select("event_id", F.col("stable_count").cast("long").alias("stable_count"), "sealed")


@entry("SELECT l_orderkey, l_linenumber, least(500 * pow(2, least(l_linenumber, 20) - 1), 10000)::BIGINT AS delay_ms FROM lineitem")
def retry_backoff(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.backoff(F.col("l_linenumber"), F.lit(500), F.lit(10000)).alias("delay_ms"))


@entry(f"SELECT archive_id, strftime(make_timestamp(archived_at_ms * 1000), '%Y/%m/%d') || '/L1/' || station_id || '/' || device_id || '/' || file_type || '/' || archive_id || '.log' AS relative_path, sha256('p' || chr(10) || device_id || chr(10) || file_size || chr(10) || archived_at_ms || chr(10) || 'x') AS task_id FROM {ARCHIVES_SQL}")
def archive_path(spark, sf):
    c = F.col
    return archives(spark, sf).select("archive_id", S.archive_path(c("archived_at_ms"), F.lit("L1"), c("station_id"), c("device_id"), c("file_type"), c("archive_id").cast("string"), F.lit("log")).alias("relative_path"), S.task_id(F.lit("p"), c("device_id"), c("file_size"), c("archived_at_ms"), F.lit("x")).alias("task_id"))


@entry("SELECT c_custkey, regexp_matches(replace(c_name, '#', '-'), '^[A-Z0-9_-]{2,64}$') AS plain, regexp_matches(upper(replace(c_name, '#', '-')), '^[A-Z0-9_-]{2,64}$') AS upper FROM customer")
def identifier_check(spark, sf):
    n = F.replace("c_name", F.lit("#"), F.lit("-"))
    return table(spark, sf, "customer").select("c_custkey", S.is_identifier(n).alias("plain"), S.is_identifier(F.upper(n)).alias("upper"))


@entry("SELECT doc_id, strlen(text) BETWEEN 1 AND 2000 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AS text_ok, strlen(text) <= 1 + doc_id % 40 OR substr(hex(encode(text)), (3 + 2 * (doc_id % 40))::INT, 1) NOT IN ('8', '9', 'A', 'B') AS utf8_ok FROM documents")
def text_check(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.is_text(F.col("text"), 2000).alias("text_ok"), S.is_utf8(F.expr("substring(cast(text AS binary), 1, cast(1 + doc_id % 40 AS int))").cast("string")).alias("utf8_ok"))


@entry("SELECT event_type, avg(value) AS mean_value, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM (SELECT event_type, round(value)::BIGINT AS value FROM events) GROUP BY event_type")
def load_percentiles(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.round("value").cast("long").alias("value"))
    return e.groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").cast("long").alias("p95"))


@entry("SELECT doc_id AS archive_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'size' ELSE 'sha256' END AS problem FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def integrity_audit(spark, sf):
    """A tenth of the files each is missing, longer and altered."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("archive_id"), F.col("doc_id").cast("string").alias("relative_path"), F.octet_length("text").alias("file_size"), F.sha2("text", 256).alias("file_sha256"))
    k = F.col("archive_id") % 10
    disk = d.where(k != 0).select("relative_path", (F.col("file_size") + F.when(k == 1, 1).otherwise(0)).alias("length"), F.when(k == 2, F.reverse("file_sha256")).otherwise(F.col("file_sha256")).alias("sha256"))
    return archive_queries.integrity_audit(d, disk)


@entry(f"SELECT doc_id, CASE WHEN occurred_at_ms < m - 7200000 THEN CASE WHEN error_code = '' THEN 300 ELSE 600 END WHEN error_code = '' THEN 10 ELSE 30 END AS ttl FROM {LOG_SQL}, (SELECT max(occurred_at_ms) AS m FROM {LOG_SQL})")
def cache_ttl(spark, sf):
    d = log(spark, sf)
    now = d.agg(F.max("occurred_at_ms")).first()[0] or 0
    return d.select("doc_id", cache.ttl_seconds(F.lit(True), F.col("occurred_at_ms"), F.lit(now), F.col("error_code") == "").alias("ttl"))


@entry("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), q AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1 : len(p) - 1] ELSE p END AS p FROM l), r AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS line_no FROM q) SELECT doc_id, line_no, (coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset, strlen(CASE WHEN suffix(raw, chr(13)) THEN raw[1 : -2] ELSE raw END)::BIGINT AS byte_length FROM r")
def line_scan_offsets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return lines(d).select("doc_id", "line_no", "byte_offset", "byte_length")


@entry(f"SELECT doc_id, level, module_name, error_code, NULL::VARCHAR AS failure FROM {LOG_SQL}")
def kv_parse(spark, sf):
    """events written as log lines and parsed again."""
    e = log(spark, sf)
    line = F.concat_ws(" ", S.ms_to_iso(F.col("occurred_at_ms")), F.concat(F.lit("level="), "level"), F.concat(F.lit("module="), "module_name"), F.concat(F.lit("device="), "device_id"), F.concat(F.lit("code="), F.when(F.col("error_code") == "", "-").otherwise(F.col("error_code"))))
    rows = e.select("doc_id", "device_id", F.lit("ST-1").alias("station_id"), F.lit("").alias("work_order"), F.lit("").alias("product_sn"), line.alias("raw"))
    return parsers.runtime_log(rows).select("doc_id", "level", "module_name", "error_code", "failure")


@entry("SELECT p_partkey, p_name AS name, p_brand || '\"x,y\"' AS quoted, p_size::VARCHAR AS size FROM part")
def csv_parse(spark, sf):
    """part written as quoted CSV lines and parsed again."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(",", q(F.col("p_name")), q(F.concat("p_brand", F.lit('"x,y"'))), F.col("p_size").cast("string")).alias("line"))
    f = parsers.csv_fields(F.col("line"))
    return p.select("p_partkey", f[0].alias("name"), f[1].alias("quoted"), f[2].alias("size"))


@entry("SELECT o_orderkey, try_cast(o_totalprice::VARCHAR AS DOUBLE) AS number FROM orders")
def number_parse(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.finite_number(F.col("o_totalprice").cast("string")).alias("number"))


@entry(f"SELECT archive_id, device_id || CASE WHEN archive_id % 3 = 0 THEN '.LOG' WHEN archive_id % 3 = 1 THEN '.x.csv' ELSE '.' END AS name, CASE WHEN archive_id % 3 = 0 THEN 'log' WHEN archive_id % 3 = 1 THEN 'csv' END AS extension, (archive_id % 3 = 0 AND file_type = 'RUNTIME_LOG') OR (archive_id % 3 = 1 AND file_type = 'TEST_REPORT') AS allowed FROM {ARCHIVES_SQL}")
def extension_check(spark, sf):
    k = F.col("archive_id") % 3
    a = archives(spark, sf).withColumn("name", F.concat("device_id", F.when(k == 0, ".LOG").when(k == 1, ".x.csv").otherwise(".")))
    return a.select("archive_id", "name", S.extension(F.col("name")).alias("extension"), S.extension_allowed(F.col("name"), F.col("file_type")).alias("allowed"))


@entry("SELECT CASE event_type WHEN 'error' THEN 'RETRY' WHEN 'view' THEN 'SESSION_MISSING' WHEN 'click' THEN 'OK' ELSE 'FAIL' END AS action, count(*) AS n FROM events GROUP BY 1")
def response_classes(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "error", 503).when(t == "view", 404).when(t == "click", 200).otherwise(403)
    code = F.when(t == "view", "UPLOAD_NOT_FOUND").otherwise("")
    return table(spark, sf, "events").select(sessions.response_class(status, code).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@entry("SELECT l_orderkey::VARCHAR AS session, l_linenumber::BIGINT + 1 AS seq, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber) > 1)::INT AS code FROM lineitem UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, 0, 1 FROM lineitem")
def upload_fold(spark, sf):
    """Upload sessions of one create event and a chunk for each line."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("session"), "l_linenumber")
    create = li.select("session").distinct().select("session", F.lit(0).cast("long").alias("seq"), F.lit("create").alias("kind"), F.lit(7).cast("long").alias("number"), F.lit("").alias("digest"))
    chunk = li.select("session", (F.col("l_linenumber") + 1).cast("long").alias("seq"), F.lit("chunk").alias("kind"), (F.col("l_linenumber") - 1).cast("long").alias("number"), F.concat("session", F.lit("-"), "l_linenumber").alias("digest"))
    return sessions.fold_sessions(create.union(chunk)).select("session", "seq", "code")


@entry(f"SELECT batch_id, count(*) AS documents, sum(file_size)::BIGINT AS total_terms, round(avg(file_size), 6) AS average_length, min(archived_at_ms) AS min_occurred_at_ms, max(archived_at_ms) AS max_occurred_at_ms FROM {ARCHIVES_SQL} GROUP BY batch_id")
def segment_stats(spark, sf):
    d = archives(spark, sf).select("batch_id", F.col("file_size").alias("term_count"), F.col("archived_at_ms").alias("occurred_at_ms"))
    return index.segment_stats(d).withColumn("average_length", F.round("average_length", 6))


@entry("SELECT term, count(*) AS df FROM (SELECT DISTINCT term, doc_id FROM " + POSTINGS_SQL + ") GROUP BY term")
def stream_incremental_index(spark, sf):
    """documents as a stream, indexed batch by batch into Parquet, then read back."""
    from ..streaming.jobs import index_stream

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet") if _is_dir(spark, f"{sf}/documents.parquet") else spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    index_stream(source, base, f"{base}/checkpoint").awaitTermination()
    return spark.read.option("basePath", f"{base}/postings").parquet(f"{base}/postings").groupBy("term").agg(F.count("*").alias("df"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


from . import index_queries, record_queries, request_queries  # noqa: E402, F401  register further queries
