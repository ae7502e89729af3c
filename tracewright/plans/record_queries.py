"""Further queries of the catalogue: rules of records, states, sessions, files and the stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive_queries, artifacts, index, parsers, search, service, sessions, state
from ..sources import archives as archive_source
from ..sources import files, storage
from .catalogue import entry
from .roles import ARCHIVES_SQL, LOG_SQL, POSTINGS_SQL, TEXTS_SQL, archives, log, table, texts
from .stored import shared_dir

#: What each of ten ways to write a number is worth (k is the key).
_WORTH = ("k", "k", "k + 0.5", "NULL", "k", "NULL", "NULL", "-5", "NULL", "NULL")


@entry("SELECT o_orderkey AS k, (CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {w.replace('k', 'o_orderkey')}" for i, w in enumerate(_WORTH)) + " END)::DOUBLE AS number FROM orders WHERE o_orderkey > 0")
def number_forms(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("k"))
    k = F.col("k").cast("string")
    forms = [k, F.concat(F.lit(" "), k), F.concat(k, F.lit(".50")), F.concat(k, F.lit("\n")), F.concat(F.lit("0x"), F.lower(F.hex("k"))), F.lit("nan"), F.concat(k, F.lit("e400")), F.lit("-.5e1"), F.concat(k, F.lit("d")), F.lit("")]
    return o.select("k", S.finite_number(F.element_at(F.array(*forms), (F.col("k") % 10 + 1).cast("int"))).alias("number"))


@entry("SELECT c_custkey AS k, c_custkey % 3 <> 0 AS identifier, c_custkey % 3 = 1 AS printable, c_custkey % 3 = 1 AS uuid FROM customer")
def whole_text_checks(spark, sf):
    """A final line feed, which a regular expression's dollar would let pass, fails every check but that of identifiers without one."""
    k = F.col("c_custkey")
    end = F.when(k % 3 == 0, "\n").otherwise("")
    odd = F.when(k % 3 == 2, "\u00e9").otherwise("")
    u = F.concat(F.lpad(F.lower(F.hex(k)), 8, "0"), F.lit("-0000-4000-8000-000000000000"), odd, end)
    return table(spark, sf, "customer").select(k.alias("k"), S.is_identifier(F.concat(F.lit("DEV-"), k.cast("string"), end)).alias("identifier"), S.is_printable(F.concat(F.lit("a b"), odd, end), 64).alias("printable"), S.is_uuid(u).alias("uuid"))


@entry("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN '18446744073709551615' END AS value FROM orders")
def unsigned_parse(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("00"), k.cast("string"))).when(k % 4 == 1, "18446744073709551615").when(k % 4 == 2, "18446744073709551616").otherwise(F.concat(F.lit("+"), k.cast("string")))
    return table(spark, sf, "orders").select(k.alias("k"), S.unsigned(text).cast("string").alias("value"))


@entry("SELECT p_partkey AS k, i AS number, i < 8 AND (p_size >> greatest(7 - i, 0)) & 1 = 1 AS done FROM part, range(9) t(i)")
def bitmap_read(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.unhex(F.lpad(F.hex("p_size"), 2, "0")).alias("bits"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("number"))
    return p.select("k", "number", S.chunk_done(F.col("bits"), F.col("number")).alias("done"))


_PAD = "unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(('0x' || substr(rpad(hex(encode('key-' || c_custkey)), 128, '0'), (i * 2 + 1)::INT, 2))::INT, {pad}))), ''))"


@entry(f"SELECT c_custkey AS k, sha256({_PAD.format(pad=0x5C)} || unhex(sha256({_PAD.format(pad=0x36)} || encode('v1' || chr(10) || 'GET' || chr(10) || '/' || chr(10) || 'D' || chr(10) || c_custkey || chr(10) || 'r' || chr(10) || c_name)))) AS signature FROM customer")
def request_signature(spark, sf):
    k = F.col("c_custkey").cast("string")
    text = S.canonical_request(F.lit("GET"), F.lit("/"), F.lit("D"), k, F.lit("r"), F.col("c_name"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), S.hmac_sha256(F.concat(F.lit("key-"), k).cast("binary"), text).alias("signature"))


@entry("SELECT c_custkey AS k, 'OK' AS auth_code FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'SIGNATURE_INVALID' WHEN 2 THEN 'TIMESTAMP_EXPIRED' WHEN 3 THEN 'DEVICE_DISABLED' ELSE 'AUTH_REQUIRED' END FROM customer WHERE c_custkey % 5 <> 0")
def authentication(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    devices = c.select(k.cast("string").alias("device_id"), (k % 5 != 3).alias("enabled"), F.lit(b"secret").cast("binary").alias("hmac_secret"))
    r = c.select(k.alias("k"), k.cast("string").alias("device_id"), F.when(k % 5 == 2, 1).otherwise(5000).cast("long").alias("ts_s"), F.lit("GET").alias("method"), F.lit("/x").alias("path"), F.when(k % 5 != 4, "r").alias("request_id"), F.lit("b").alias("body_sha256"))
    good = S.hmac_sha256(F.lit(b"secret").cast("binary"), S.canonical_request(F.col("method"), F.col("path"), F.col("device_id"), F.col("ts_s").cast("string"), F.lit("r"), F.col("body_sha256")))
    return service.authenticate(r.withColumn("signature", F.when(k_is_one(), "no").otherwise(good)), devices, 5100).select("k", "auth_code")


def k_is_one():
    return F.col("k") % 5 == 1


@entry("SELECT c_custkey AS k, url_encode(c_name || ' ~*/é') AS encoded, 'x y' || c_custkey AS decoded FROM customer")
def url_coding(spark, sf):
    k = F.col("c_custkey").cast("string")
    q = F.concat(F.lit("a=1&name=x%20y"), k, F.lit("&name=z"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), S.percent_encode(F.concat("c_name", F.lit(" ~*/\u00e9"))).alias("encoded"), S.query_value(q, "name").alias("decoded"))


@entry("SELECT event_id AS k, printf('srv-%016x-%08x', epoch_us(ts), event_id) AS request_id FROM events")
def request_ids(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), S.sequenced_request_id(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")).alias("request_id"))


@entry(f"SELECT archive_id, coalesce(CASE WHEN file_type = 'TEST_REPORT' THEN archive_id % 2 = 0 AND result IS NOT NULL WHEN file_type = 'NG_IMAGE' THEN archive_id % 2 = 0 AND result = 'NG' ELSE true END, false) AS complete FROM {ARCHIVES_SQL}")
def business_completeness(spark, sf):
    sn = F.when(F.col("archive_id") % 2 == 0, "SN").otherwise("")
    return archives(spark, sf).select("archive_id", S.is_complete(F.col("file_type"), sn, F.col("result")).alias("complete"))


@entry("SELECT event_id AS k, event_type IN ('view', 'click') OR (event_type = 'purchase' AND event_id % 2 = 0) AS ok FROM events")
def heartbeat_rules(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "view", "IDLE").when(t == "click", "IDLE").when(t == "purchase", "RUNNING").otherwise("GONE")
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), sessions.heartbeat_ok(status, F.when(F.col("event_id") % 2 == 0, "WO")).alias("ok"))


@entry("SELECT doc_id, len(string_split(text, ',')) AS parts FROM documents")
def split_levels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(S.levels_split(F.col("text"))).cast("long").alias("parts"))


@entry(f"SELECT archive_id FROM {ARCHIVES_SQL} WHERE state = '1-URGENT' ORDER BY archive_id LIMIT 50")
def pending_scan(spark, sf):
    a = archives(spark, sf)
    return archive_source.pending(a.withColumn("state", F.when(F.col("state") == "1-URGENT", "PENDING").otherwise("INDEXED")), 50)


@entry("SELECT c_custkey::VARCHAR AS device_id, 1 AS parser_version FROM customer WHERE c_acctbal > 0")
def profile_scan(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("device_id"), F.lit("RUNTIME_LOG").alias("file_type"), F.lit("p").alias("profile_name"), (F.col("c_acctbal") > 0).alias("enabled"))
    return archive_source.profiles(t).select("device_id", "parser_version")


@entry("SELECT n_nationkey AS batch_id FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 3")
def batch_scan(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("batch_id"), F.when(F.col("n_regionkey") == 1, "READY").otherwise("FAILED").alias("state"))
    return archive_source.batches(t, "READY", 3).select("batch_id")


@entry("SELECT o_orderkey AS archive_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CONFLICT' ELSE 'INSERTED' END AS outcome FROM orders")
def archive_insert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("archive_id"), F.col("o_orderkey").cast("string").alias("upload_id"))
    fresh, conflict = archive_queries.insert_new(o.where("archive_id % 2 = 0"), o)
    return fresh.select("archive_id", F.lit("INSERTED").alias("outcome")).union(conflict.select("archive_id", F.lit("CONFLICT").alias("outcome")))


def _archive_rows(spark, sf):
    empty = {c: F.lit("") for c in ("line_id", "collector_id", "product_sn", "original_filename", "relative_path")}
    return archives(spark, sf).withColumns(empty | {"upload_id": F.col("archive_id").cast("string"), "file_sha256": F.unhex(F.sha2(F.col("archive_id").cast("string"), 256)), "produced_at": F.col("archived_at")})


@entry(f"SELECT archive_id, sha256(archive_id::VARCHAR) AS file_sha256, 16 AS columns, 14 AS source_columns FROM {ARCHIVES_SQL}")
def archive_projection(spark, sf):
    a = _archive_rows(spark, sf)
    return archive_queries.full(a).select("archive_id", "file_sha256", F.lit(len(archive_queries.full(a).columns)).alias("columns"), F.lit(len(archive_queries.source_columns(a).columns)).alias("source_columns"))


@entry(f"SELECT archive_id, work_order, NULL::VARCHAR AS product_sn, result, archive_id::VARCHAR AS upload_id FROM {ARCHIVES_SQL}")
def archive_detail(spark, sf):
    return archive_queries.summary(_archive_rows(spark, sf), detail=True).select("archive_id", "work_order", "product_sn", "result", "upload_id")


@entry("SELECT p_partkey AS k, p_partkey % 5 < 2 AS safe, p_partkey % 5 < 4 AS input FROM part")
def path_rules(spark, sf):
    k = F.col("p_partkey")
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/b.c", "a/..b", "a/../b", "/a", "a//b")]), (k % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.csv", "b.part.csv", "c.tmp\n", "d", ".e")]), (k % 5 + 1).cast("int"))
    p = table(spark, sf, "part").select(k.alias("k"), files.safe(path).alias("safe"), name.alias("name"))
    kept = files.device_inputs(p).select("k", F.lit(True).alias("input"))
    return p.join(kept, "k", "left").select("k", "safe", F.coalesce("input", F.lit(False)).alias("input"))


@entry("SELECT event_id AS k, event_id % 4 = 0 AS sidecar_ok, CASE WHEN event_id % 4 = 0 THEN 3 END AS chunks, event_id % 3 = 0 AS jsonl_ok FROM events")
def sidecar_read(spark, sf):
    k = F.col("event_id")
    good = '{"work_order":null,"product_sn":"P","file_type":"TEST_REPORT","result":"PASS","produced_at":"2031-02-03T04:05:06.007Z"}'
    forms = [good, good.replace(".007", ""), good[:-1] + ',"x":1}', good.replace('"P"', "5")]
    lines = ['{"a":1}\n', '{"a":1}', '{"a":1}\n\n']
    pick = lambda a, n: F.element_at(F.array(*[F.lit(x) for x in a]), (k % n + 1).cast("int"))
    e = table(spark, sf, "events").select(k.alias("k"), pick(forms, 4).alias("json"), pick(lines, 3).alias("jsonl"), F.lit(2_300_000).alias("file_size"))
    return files.sidecars(e).select("k", "sidecar_ok", F.when(F.col("sidecar_ok"), F.col("chunk_count")).cast("int").alias("chunks"), files.jsonl_ok(F.col("jsonl")).alias("jsonl_ok"))


@entry("SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS valid, CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey END AS file_size FROM orders")
def session_read(spark, sf):
    k = F.col("o_orderkey")
    named = [x for c in sessions.SESSION_TEXT if c != "state" for x in (F.lit(c), F.lit("v"))]
    numbers = [x for c in sessions.SESSION_NUMBERS[1:] for x in (F.lit(c), F.lit("7"))]
    size = F.when(k % 3 == 1, "7x").otherwise(F.col("o_custkey").cast("string"))
    fields = F.create_map(*named, *numbers, F.lit("file_size"), size)
    rows = table(spark, sf, "orders").select(k.alias("k"), F.when(k % 3 == 2, fields).otherwise(F.map_concat(fields, F.create_map(F.lit("state"), F.lit("UPLOADING")))).alias("fields"))
    return sessions.read_sessions(rows).select("k", "valid", "file_size")


@entry("SELECT n_nationkey AS batch_id, CASE n_regionkey WHEN 0 THEN 'FAILED' WHEN 1 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'PARSED' WHEN n_nationkey % 3 = 1 THEN 'READY' ELSE 'FAILED' END ELSE 'READY' END AS state, CASE WHEN n_regionkey = 0 THEN 'BATCH_INTERRUPTED' WHEN n_regionkey = 1 AND n_nationkey % 3 = 2 THEN 'SEGMENT_RECOVERY_CORRUPTED' END AS failure_code FROM nation")
def crash_recovery(spark, sf):
    r = F.col("n_regionkey")
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("batch_id"), F.when(r == 0, "PARSING").when(r == 1, "BUILDING").otherwise("READY").alias("state"), F.lit(None).cast("string").alias("failure_code"))
    return state.recover(b, [i for i in range(25) if i % 3], [i for i in range(25) if i % 3 == 1]).select("batch_id", "state", "failure_code")


@entry(f"SELECT archive_id, CASE WHEN result IS NULL THEN 'FAILED' ELSE 'PARSED' END AS state, CASE WHEN result IS NULL THEN 'RUNTIME_LOG_EMPTY' END AS failure_code, CASE WHEN result IS NULL THEN 3 END AS failure_line, file_size AS document_count FROM {ARCHIVES_SQL}")
def attach_outcomes(spark, sf):
    a = archives(spark, sf)
    held = a.select("archive_id", "batch_id", F.lit("FAILED").alias("state"), F.lit(0).cast("long").alias("document_count"), F.lit("OLD").alias("failure_code"), F.lit(1).cast("long").alias("failure_line")).where("archive_id % 2 = 0")
    bad = F.col("result").isNull()
    outcomes = a.select("archive_id", F.when(bad, "RUNTIME_LOG_EMPTY").alias("failure_code"), F.col("file_size").alias("document_count"), F.when(bad, 3).cast("long").alias("failure_line"))
    return state.apply_outcomes(state.attach(held, a, 9), outcomes).select("archive_id", "state", "failure_code", F.col("failure_line").cast("int").alias("failure_line"), "document_count")


@entry(f"SELECT archive_id, CASE WHEN batch_id = 5 THEN 'PENDING' ELSE 'INDEXED' END AS state FROM {ARCHIVES_SQL}")
def rebuild_request(spark, sf):
    i = archives(spark, sf).select("archive_id", "batch_id", F.lit("INDEXED").alias("state"), F.lit(1).cast("long").alias("document_count"), F.lit(None).cast("string").alias("failure_code"))
    b = spark.range(13).select(F.col("id").alias("batch_id"), F.lit("READY").alias("state"), F.lit(None).cast("string").alias("failure_code"))
    one = i.where("batch_id = 5").agg(F.min("archive_id")).first()[0]
    return state.request_rebuild(b, i, one if one is not None else -1)[1].select("archive_id", "state")


@entry("SELECT event_id AS k, CASE event_type WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'UPLOADING' WHEN 1 THEN 'COMPLETING' WHEN 2 THEN 'DONE' ELSE 'FAILED' END WHEN 'view' THEN 'READY' WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'UPLOADING' WHEN 2 THEN 'COMPLETING' ELSE 'FAILED' END ELSE 'FAILED' END AS next FROM events")
def task_states(spark, sf):
    now = F.element_at(F.array(*[F.lit(x) for x in ("READY", "UPLOADING", "COMPLETING", "FAILED")]), (F.col("event_id") % 4 + 1).cast("int"))
    t = F.col("event_type")
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), sessions.next_task(now, F.when(t == "click", "OK").when(t == "view", "SESSION_MISSING").when(t == "error", "RETRY").otherwise("FAIL")).alias("next"))


@entry("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_custkey < 100")
def cleanup_scan(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lpad(F.lower(F.hex(k)), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    o = table(spark, sf, "orders").select(k.alias("k"), name.alias("session"), F.col("o_custkey").alias("mtime_s"))
    live = o.where("k % 4 <> 0").select("session", F.when(F.col("k") % 4 == 1, "ARCHIVED").otherwise("UPLOADING").alias("state"))
    return sessions.cleanup(o.withColumn("name", F.concat("session", F.lit(".part"))), live, 100).select("k")


@entry("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'SKIP' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'SOURCE_CHANGED_AFTER_SEAL' ELSE 'TAKE' END AS action FROM orders")
def changed_sources(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.lit(5).alias("size"), F.lit(1).alias("mtime"))
    known = o.where("k % 3 < 2").select("path", (F.col("size") + F.col("k") % 3).alias("size"), "mtime", F.when(F.col("k") % 2 == 0, "UPLOADING").otherwise("DONE").alias("state"))
    return sessions.changed_source(known, o).select("k", "action")


@entry("WITH n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1) SELECT l_orderkey::VARCHAR AS session, seq, CASE seq WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 4 END WHEN 5 THEN CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 4 END WHEN 6 THEN 1 ELSE CASE WHEN l_orderkey % 4 = 0 THEN 2 ELSE 3 END END AS code FROM n, range(8) t(seq)")
def upload_completion(spark, sf):
    """Create, complete too early, a chunk, another content for it, complete twice, the verdict, and complete again."""
    k = F.col("l_orderkey")
    s = table(spark, sf, "lineitem").select(k).distinct().select(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("seq"))
    q = F.col("seq")
    kind = F.when(q == 0, "create").when(q.isin(2, 3), "chunk").when(q == 6, "verified").otherwise("complete")
    number = F.when(q == 0, F.when(k % 2 == 0, 1).otherwise(2)).otherwise(0).cast("long")
    digest = F.when(q == 2, "a").when(q == 3, "b").when((q == 6) & (k % 4 == 0), "ok").otherwise("")
    return sessions.fold_sessions(s.select(k.cast("string").alias("session"), "seq", kind.alias("kind"), number.alias("number"), digest.alias("digest"))).select("session", "seq", "code")


@entry("SELECT doc_id, strlen(text)::BIGINT AS length, sha256(text) AS sha256 FROM documents WHERE strlen(text) > 0 AND doc_id % 7 <> 0")
def assembled_files(spark, sf):
    """Texts cut into chunks of 700 bytes, some sent twice, and put together; of every seventh the first chunk is missing."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("b"), F.octet_length("text").cast("long").alias("file_size"), F.lit(700).cast("long").alias("chunk_size")).where("file_size > 0")
    c = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), S.chunk_count(F.col("file_size"), F.col("chunk_size")) - 1)).alias("number")).where("doc_id % 7 <> 0 OR number > 0")
    c = c.select(F.col("doc_id").alias("session"), "number", F.expr("substring(b, cast(number * 700 + 1 AS int), 700)").alias("data"), "file_size", "chunk_size")
    return storage.assemble(c.union(c.where("number % 2 = 1"))).select(F.col("session").alias("doc_id"), "length", "sha256")


@entry("SELECT s_suppkey AS k, s_nationkey >= 5 AND (s_nationkey + 10 - 5) * 100 >= 25 * 30 AS water, 10 + s_nationkey <= 20 AS room FROM supplier")
def capacity_rules(spark, sf):
    n = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), storage.above_low_water(n + 10, F.lit(25), F.lit(5), F.lit(10), F.lit(30)).alias("water"), storage.spool_has_room(n, F.lit(10), F.lit(20), F.lit(1000), F.lit(1)).alias("room"))


@entry("SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'RUNTIME_LOG_TIME_INVALID' WHEN 4 THEN 'RUNTIME_LOG_METADATA_MISMATCH' WHEN 8 THEN 'INVALID_UTF8' WHEN 7 THEN NULL ELSE 'RUNTIME_LOG_FORMAT_INVALID' END AS failure FROM part")
def kv_failures(spark, sf):
    t = "2031-02-03T04:05:06.007Z"
    forms = [f"{t} level=INFO module=m", "2031-02-30T04:05:06.007Z level=INFO module=m", f"{t} level=INFO  module=m", f"{t} level=INFO module=a=b", f"{t} level=INFO module=m device=OTHER", f"{t} level=LOUD module=m", f"{t} level=INFO", f"{t} level=WARN module=m code=- ", f"{t} level=INFO module=\xc0\xaf"]
    line = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lit("D").alias("device_id"), F.lit("S").alias("station_id"), F.lit("").alias("work_order"), F.lit("").alias("product_sn"), line.alias("raw"))
    return parsers.runtime_log(rows).select("k", "failure")


_REPORT = ["ReportVersion,1.2", "DeviceId,D", "WorkOrder,W", "ProductSN,P", "TestedAt,2031-02-03T04:05:06.007Z", "OverallResult,PASS", "TestPoint,TestName,LowerLimit,UpperLimit,Measured,Unit,Result"]


@entry("SELECT p_partkey AS archive_id, CASE p_partkey % 5 WHEN 1 THEN 'FCT_CSV_ROW_INVALID' WHEN 2 THEN 'FCT_CSV_METADATA_MISMATCH' WHEN 3 THEN 'FCT_CSV_EMPTY' END AS failure_code, CASE p_partkey % 5 WHEN 1 THEN 9 WHEN 2 THEN 6 END AS failure_line, CASE WHEN p_partkey % 5 IN (0, 4) THEN 2 ELSE 0 END AS document_count FROM part")
def report_outcomes(spark, sf):
    """parse_archives over one report for each part: rows out of order of their limits, another device, no rows."""
    k = F.col("archive_id")
    head = F.concat_ws("\n", *[F.when(k % 5 == 2, "DeviceId,E").otherwise(x) if x == "DeviceId,D" else F.lit(x) for x in _REPORT])
    rows = F.when(k % 5 == 3, "").otherwise(F.concat(F.lit("\na,b,0x1,2,1.5,u,PASS\n\"c\",d,"), F.when(k % 5 == 1, "9").otherwise("1"), F.lit(",2,3,u,NG")))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("archive_id")).withColumn("content", F.concat(head, rows, F.lit("\n")).cast("binary"))
    p = p.withColumns({"relative_path": F.concat(F.lit("r/"), k.cast("string")), "length": F.octet_length("content"), "sha256": F.sha2("content", 256)})
    a = p.select("archive_id", "relative_path", F.col("length").alias("file_size"), F.col("sha256").alias("file_sha256"), *[F.lit(v).alias(c) for c, v in {"line_id": "L", "station_id": "S", "device_id": "D", "collector_id": "C", "work_order": "W", "product_sn": "P", "file_type": "TEST_REPORT"}.items()], F.lit("2031-02-03").cast("timestamp").alias("archived_at"))
    profiles = spark.range(1).select(F.lit("D").alias("device_id"), F.lit("TEST_REPORT").alias("file_type"), F.lit("fct_csv_v1").alias("profile_name"))
    return parsers.parse_archives(a, p.select("relative_path", "length", "sha256", "content"), profiles)[1].select("archive_id", "failure_code", F.col("failure_line").cast("int").alias("failure_line"), F.col("document_count").cast("int").alias("document_count"))


@entry("SELECT doc_id AS archive_id, CASE doc_id % 10 WHEN 0 THEN 'ARCHIVE_FILE_NOT_FOUND' WHEN 1 THEN 'ARCHIVE_SIZE_MISMATCH' ELSE 'ARCHIVE_SHA256_MISMATCH' END AS failure_code FROM documents WHERE doc_id % 10 < 3")
def originals_check(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("archive_id"), F.col("doc_id").cast("string").alias("relative_path"), F.octet_length("text").alias("file_size"), F.sha2("text", 256).alias("file_sha256"))
    k = F.col("archive_id") % 10
    disk = d.where(k != 0).select("relative_path", (F.col("file_size") + F.when(k == 1, 1).otherwise(0)).alias("length"), F.when(k == 2, F.reverse("file_sha256")).otherwise(F.col("file_sha256")).alias("sha256"))
    return index.verify_originals(d, disk)


@entry("SELECT count(*) AS checked, count(*) FILTER (doc_id % 10 = 0) AS missing, count(*) FILTER (doc_id % 10 = 1) AS size, 0 AS sha256 FROM documents")
def integrity_counters(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id") % 10
    return archive_queries.integrity_summary(d, d.select(F.when(k == 0, "missing").when(k == 1, "size").alias("problem"))).withColumn("sha256", F.col("sha256").cast("int"))


@entry("SELECT 'document_count_differs' AS rule, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0")
def artifact_rules(spark, sf):
    """Archives that say one document too many, by the rules of a parsed batch."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("archive_id"), *[F.lit("x").alias(c) for c in artifacts.INHERITED])
    return artifacts.violations(n.withColumn("document_count", F.when(F.col("archive_id") % 2 == 0, 2).otherwise(1).cast("long")), n.withColumn("local_id", F.col("archive_id")))


@entry("SELECT n_nationkey AS k, printf('{\"code\":\"OK\",\"message\":\"ok\",\"request_id\":\"q\",\"data\":{\"n_nationkey\":%d}}', n_nationkey) AS reply FROM nation")
def reply_envelope(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey")
    return service.envelope(n, "q").select(F.get_json_object("reply", "$.data.n_nationkey").cast("int").alias("k"), "reply")


@entry("SELECT event_type, count(*) AS n, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 404 WHEN 'click' THEN 200 ELSE 500 END AS status FROM events GROUP BY 1")
def status_codes(spark, sf):
    t = F.col("event_type")
    code = F.when(t == "error", "UPLOAD_LIMIT_EXCEEDED").when(t == "view", "ARCHIVE_NOT_FOUND").when(t == "click", "OK").otherwise("NEW")
    return table(spark, sf, "events").select("event_type", service.status(code, service.ARCHIVE_STATUS).alias("status")).groupBy("event_type", "status").agg(F.count("*").alias("n"))


def _engine(spark, sf):
    """documents as a stored index of one batch, opened as an engine."""
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    d = texts(spark, sf).withColumns({"occurred_at_ms": F.col("doc_id"), "level": F.when(F.col("doc_id") % 10 == 0, "ERROR").otherwise("INFO"), "error_code": F.when(F.col("doc_id") % 10 == 0, "E").otherwise(""), "module_name": F.col("source"), "device_id": F.col("lang")})
    d.drop("text").withColumn("local_id", F.col("doc_id")).write.parquet(f"{root}/documents/batch_id=1")
    index.postings(table(spark, sf, "documents").select("doc_id", "text")).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{root}/postings/batch_id=1")
    index.term_dictionary(index.load(spark, root, "postings", [1])).write.parquet(f"{root}/terms/batch_id=1")
    index.segment_stats(index.load(spark, root, "documents", [1])).drop("batch_id").write.parquet(f"{root}/stats/batch_id=1")
    t = {n: index.load(spark, root, n, [1]) for n in ("documents", "postings", "stats", "terms")}
    return search.SearchEngine(t["documents"], t["postings"], t["stats"], t["terms"], [1])


_ENGINE_SQL = f"""(WITH d AS {TEXTS_SQL}, p AS {POSTINGS_SQL}, s AS (SELECT count(*) AS n, avg(term_count) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('of', 'the') GROUP BY term),
  x AS (SELECT p.doc_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * term_count / avgdl)) AS part FROM p JOIN f USING (term) JOIN d USING (doc_id), s WHERE lang = 'en')
  SELECT doc_id, sum(part ORDER BY term) + CASE WHEN doc_id % 10 = 0 THEN 2.0 ELSE 0.0 END AS score FROM x GROUP BY doc_id HAVING count(*) = 2)"""


@entry(f"SELECT doc_id, round(score, 8) AS score, (SELECT count(*) FROM {_ENGINE_SQL}) AS total_hits FROM {_ENGINE_SQL} ORDER BY round(score, 10) DESC, doc_id DESC LIMIT 20 OFFSET 5")
def engine_search(spark, sf):
    """A filtered page through the stored index: postings of the query's terms, dictionary, statistics, weights and rank."""
    page = _engine(spark, sf).search(search.SearchQuery(["The", "of"], device_id="en", offset=5, page_size=20))
    return page.items.select("doc_id", F.round("score", 8).alias("score"), F.lit(page.total_hits).cast("long").alias("total_hits"))


@entry("SELECT doc_id, 2.0::DOUBLE AS score FROM documents WHERE doc_id % 10 = 0 AND lang = 'en' ORDER BY doc_id DESC LIMIT 50")
def engine_anomalies(spark, sf):
    return _engine(spark, sf).anomalies(search.SearchQuery(device_id="en")).items.select("doc_id", "score")


@entry("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 7)")
def engine_restore(spark, sf):
    e = _engine(spark, sf)
    ids = [r[0] for r in e.docs.select("doc_id").orderBy(F.desc("doc_id")).limit(7).collect()]
    return e.restore(1, ids).select("doc_id", F.col("pos").cast("long").alias("pos"))


@entry(f"SELECT doc_id, level FROM {LOG_SQL} WHERE level <> 'INFO' AND module_name = 'error' AND device_id = 'DEV-7'")
def structured_filter(spark, sf):
    q = search.validate(search.SearchQuery(levels=["WARN", "ERROR"], module_name="error", device_id="DEV-7"))
    return search.filters(log(spark, sf), q).select("doc_id", "level")
