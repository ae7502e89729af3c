"""Line parsers: archived files to documents or one failure each.

A parser is registered by profile name and turns physical lines, joined with
their archive's row, into checked lines. The first failure of a file wins and
drops its documents; failures of the whole file (path, size, hash) override it.
``admit``, ``parse_lines``, ``outcomes_of`` and ``documents_of`` are the steps;
what a step gives is stored by the caller before the next, so that a line is
read and parsed once. Spark takes compressed tables and their lines for smaller
than they are, so tables with a row for each file or line are joined by sorting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_number, iso_to_ms, tokens
from ..sources.files import lines, safe, utf8

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")
MAX_LINE_BYTES = 65536
#: The header keys and columns of a test report.
REPORT_KEYS = ("ReportVersion", "DeviceId", "WorkOrder", "ProductSN", "TestedAt", "OverallResult")
REPORT_COLUMNS = ("TestPoint", "TestName", "LowerLimit", "UpperLimit", "Measured", "Unit", "Result")
#: A quoted or bare field; possessive, so that long lines are matched by loops instead of recursion.
_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
FIELDS = ("occurred_at_ms", "level", "module_name", "error_code", "event_name", "doc_work_order", "doc_product_sn")


def csv_fields(text: Column) -> Column:
    """Fields of one CSV line: quotes enclose a whole field or are invalid, "" is a quote inside; null where a quote is misplaced or stays open."""
    ok = text.rlike(rf"(?s)^{_FIELD}(?:,{_FIELD})*+$")
    parts = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(rf"(?s),({_FIELD})"), 1)
    plain = F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))
    return F.when(ok, plain)


def key_values(text: Column) -> Column:
    """Map of single-space separated k=v pairs, with one trailing space allowed; null where malformed or a key repeats."""
    pairs = F.split(F.regexp_replace(text, " $", ""), " ")
    good = F.forall(pairs, lambda p: p.rlike(r"(?s)^[^= ]+=[^= ]+$"))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).alias("v")))
    none = F.create_map().cast("map<string,string>")
    return F.when(text == "", none).when(good & unique, F.map_from_entries(entries))


def _mismatch(value: Column, expected: Column) -> Column:
    return value.isNotNull() & ~value.eqNullSafe(expected)


def _runtime_log(rows: DataFrame, on: Column) -> tuple[DataFrame, dict[str, Column], list[str]]:
    t = F.when(on, utf8(F.col("raw")))
    rows = rows.withColumn("__t", t).withColumns({"__ms": iso_to_ms(F.substring_index(F.col("__t"), " ", 1)), "__kv": key_values(F.regexp_extract("__t", r"(?s)^[^ ]* (.*)$", 1))})
    kv = lambda k: F.try_element_at(F.col("__kv"), F.lit(k))
    given_sn = F.coalesce(F.col("product_sn"), F.lit(""))
    failure = (
        F.when(F.col("raw") == "", "RUNTIME_LOG_FORMAT_INVALID")
        .when(F.col("__t").isNull(), "INVALID_UTF8")
        .when(~F.col("__t").contains(" "), "RUNTIME_LOG_FORMAT_INVALID")
        .when(F.col("__ms").isNull(), "RUNTIME_LOG_TIME_INVALID")
        .when(F.col("__kv").isNull() | kv("level").isNull() | kv("module").isNull() | ~kv("level").isin(*LEVELS), "RUNTIME_LOG_FORMAT_INVALID")
        .when(_mismatch(kv("device"), F.col("device_id")) | _mismatch(kv("source_device"), F.col("device_id")) | _mismatch(kv("station"), F.col("station_id")), "RUNTIME_LOG_METADATA_MISMATCH")
        .when((given_sn != "") & _mismatch(kv("sn"), given_sn), "RUNTIME_LOG_METADATA_MISMATCH")
    )
    code = F.coalesce(kv("code"), F.lit(""))
    made = {
        "occurred_at_ms": F.col("__ms"), "level": kv("level"), "module_name": kv("module"), "error_code": F.when(code == "-", "").otherwise(code), "event_name": F.coalesce(kv("event"), F.lit("")),
        "doc_work_order": F.coalesce("work_order", F.lit("")), "doc_product_sn": F.coalesce(kv("sn"), F.col("product_sn"), F.lit("")), "failure": failure, "is_document": failure.isNull(),
    }
    return rows, made, ["__t", "__ms", "__kv"]


def runtime_log(rows: DataFrame) -> DataFrame:
    """kv_runtime_v1: an ISO time, then k=v pairs; adds FIELDS and failure."""
    rows, made, used = _runtime_log(rows, F.lit(True))
    return rows.withColumns(made).drop(*used)


def _head_fields(rows: DataFrame) -> DataFrame:
    """rows with the fields of a report's line; the first line may begin with a byte order mark."""
    t = utf8(F.col("raw"))
    return rows.withColumn("__r", F.when(F.col("line_no") == 1, F.regexp_replace(t, "^﻿", "")).otherwise(t)).withColumn("__f", csv_fields(F.col("__r")))


def report_heads(rows: DataFrame) -> DataFrame:
    """One row for each file with the values of its six header pairs, from those lines alone, so that a long report is never one group."""
    return _head_fields(rows.where("line_no <= 6")).where("size(__f) = 2").groupBy("archive_id").agg(*[F.max(F.when(F.col("line_no") == i + 1, F.get("__f", F.lit(1)))).alias(f"__{k}") for i, k in enumerate(REPORT_KEYS)])


def _test_report(rows: DataFrame, on: Column) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """rows have the header's values already."""
    t = F.when(on, utf8(F.col("raw")))
    rows = rows.withColumn("__r", F.when(F.col("line_no") == 1, F.regexp_replace(t, "^﻿", "")).otherwise(t)).withColumns({"__f": csv_fields(F.col("__r")), "__at": iso_to_ms(F.col("__TestedAt"))})
    at = lambda i: F.get("__f", F.lit(i))
    order, sn = F.coalesce(F.col("work_order"), F.lit("")), F.coalesce(F.col("product_sn"), F.lit(""))
    expected = F.element_at(F.array(*[F.lit(k) for k in REPORT_KEYS]), F.least(F.col("line_no"), F.lit(6)).cast("int"))
    meta_ok = (
        F.col("__DeviceId").eqNullSafe(F.col("device_id")) & F.col("__ReportVersion").eqNullSafe("1.2") & ((order == "") | F.col("__WorkOrder").eqNullSafe(order)) & ((sn == "") | F.col("__ProductSN").eqNullSafe(sn))
        & F.col("__at").isNotNull() & F.coalesce(F.col("__OverallResult").isin("PASS", "NG"), F.lit(False))
    )
    low, high = finite_number(at(2)), finite_number(at(3))
    row_ok = (F.size("__f") == 7) & F.forall(F.slice("__f", 1, 6), lambda x: x != "") & low.isNotNull() & high.isNotNull() & finite_number(at(4)).isNotNull() & (low <= high) & at(6).isin("PASS", "NG")
    n = F.col("line_no")
    failure = (
        F.when(F.col("raw") == "", "FCT_CSV_FORMAT_INVALID")
        .when(F.col("__r").isNull(), "INVALID_UTF8")
        .when(F.col("__f").isNull(), "FCT_CSV_FORMAT_INVALID")
        .when((n <= 6) & ((F.size("__f") != 2) | (at(0) != expected) | (F.coalesce(at(1), F.lit("")) == "")), "FCT_CSV_HEADER_INVALID")
        .when((n == 6) & ~meta_ok, "FCT_CSV_METADATA_MISMATCH")
        .when((n == 7) & ~F.col("__f").eqNullSafe(F.array(*[F.lit(c) for c in REPORT_COLUMNS])), "FCT_CSV_HEADER_INVALID")
        .when((n > 7) & ~F.coalesce(row_ok, F.lit(False)), "FCT_CSV_ROW_INVALID")
    )
    bad = at(6) == "NG"
    made = {
        "occurred_at_ms": F.col("__at"), "level": F.when(bad, "ERROR").otherwise("INFO"), "module_name": F.lit("fct"), "error_code": F.when(bad, "FCT_LIMIT_FAIL").otherwise(""), "event_name": F.concat(at(0), F.lit(":"), at(1)),
        "doc_work_order": F.col("__WorkOrder"), "doc_product_sn": F.col("__ProductSN"), "failure": failure, "is_document": failure.isNull() & (n > 7),
    }
    return rows, made, ["__r", "__f", "__at"]


def test_report(rows: DataFrame) -> DataFrame:
    """fct_csv_v1: six header pairs, a column line, then one document per test row; adds FIELDS and failure."""
    rows, made, used = _test_report(rows.join(report_heads(rows), "archive_id", "left"), F.lit(True))
    return rows.withColumns(made).drop(*used, *[f"__{k}" for k in REPORT_KEYS])


#: By profile: the parser of a line, and the failure of a file without a document.
PARSERS: dict[str, tuple[Callable[[DataFrame, Column], tuple[DataFrame, dict[str, Column], list[str]]], str]] = {"kv_runtime_v1": (_runtime_log, "RUNTIME_LOG_EMPTY"), "fct_csv_v1": (_test_report, "FCT_CSV_EMPTY")}

CHECKED = ("archive_id", "line_no", "byte_offset", "byte_length", "occurred_at_ms", "archived_at_ms", "term_count", "line_id", "station_id", "device_id", "collector_id", "work_order", "product_sn", "source_type", "level", "module_name", "error_code", "event_name", "raw", "failure", "is_document")


def admit(archives: DataFrame, digests: DataFrame, profiles: DataFrame) -> DataFrame:
    """archives with their profile and file_failure: no profile, an unsafe path, an unknown parser, a missing file, another size or hash, in this order."""
    a = archives.join(profiles, ["device_id", "file_type"], "left")
    a = a.join(digests.select("relative_path", F.col("length").alias("__len"), F.col("sha256").alias("__sha")).hint("merge"), "relative_path", "left")
    whole = (
        F.when(F.col("profile_name").isNull(), "PARSER_PROFILE_NOT_FOUND")
        .when(~safe(F.col("relative_path")), "ARCHIVE_PATH_INVALID")
        .when(~F.col("profile_name").isin(*PARSERS), "PARSER_PROFILE_UNSUPPORTED")
        .when(F.col("__len").isNull(), "ARCHIVE_FILE_NOT_FOUND")
        .when(F.col("__len") != F.col("file_size"), "ARCHIVE_SIZE_MISMATCH")
        .when(F.col("__sha") != F.col("file_sha256"), "ARCHIVE_SHA256_MISMATCH")
    )
    return a.withColumn("file_failure", whole).drop("__len", "__sha")


def parse_lines(admitted: DataFrame, physical: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """CHECKED columns of every physical line of the files without a failure: one pass over the lines, each parsed by its file's profile.

    Only the headers of reports are looked up apart, in the first six lines of
    their files.
    """
    rows = admitted.where("file_failure IS NULL").drop("file_failure").join(physical, "relative_path")
    profile = F.col("profile_name")
    rows = rows.join(report_heads(rows.where(profile == "fct_csv_v1")), "archive_id", "left")
    tagged = F.lit(None)
    for name, (parser, _) in PARSERS.items():
        rows, made, _ = parser(rows, profile == name)
        tagged = F.when(profile == name, F.struct(*[c.alias(k) for k, c in made.items()])).otherwise(tagged)
    rows = rows.withColumn("__p", tagged)
    failure = F.when(F.col("byte_length") > max_line_bytes, "LINE_TOO_LONG").otherwise(F.col("__p.failure"))
    return rows.select(
        "archive_id", "line_no", "byte_offset", "byte_length", "__p.occurred_at_ms", F.unix_millis("archived_at").alias("archived_at_ms"), F.size(tokens(utf8(F.col("raw")))).cast("long").alias("term_count"), "line_id", "station_id", "device_id", "collector_id",
        F.col("__p.doc_work_order").alias("work_order"), F.col("__p.doc_product_sn").alias("product_sn"), F.col("file_type").alias("source_type"), "__p.level", "__p.module_name", "__p.error_code", "__p.event_name", "raw", failure.alias("failure"), (F.col("__p.is_document") & failure.isNull()).alias("is_document"),
    )


def outcomes_of(admitted: DataFrame, checked: DataFrame) -> DataFrame:
    """One row per archive with its profile, failure code and line, and document count: the file's failure, else its first failed line, else that it has no document."""
    first = checked.groupBy("archive_id").agg(F.min(F.when(F.col("failure").isNotNull(), F.struct("line_no", "failure"))).alias("f"), F.count_if("is_document").alias("n"))
    empty = F.element_at(F.create_map(*[F.lit(x) for k, (_, e) in PARSERS.items() for x in (k, e)]), F.col("profile_name"))
    out = admitted.join(first.hint("merge"), "archive_id", "left").withColumn("failure_code", F.coalesce("file_failure", "f.failure", F.when(F.coalesce("n", F.lit(0)) == 0, empty)))
    out = out.withColumns({"failure_line": F.when(F.col("file_failure").isNull(), F.col("f.line_no")), "document_count": F.when(F.col("failure_code").isNull(), F.col("n")).otherwise(0)})
    return out.select("archive_id", "relative_path", "file_size", "file_sha256", "profile_name", "failure_code", "failure_line", "document_count")


def documents_of(checked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The documents of the files that did not fail."""
    good = outcomes.where("failure_code IS NULL").select("archive_id")
    return checked.where("is_document").drop("failure", "is_document").join(good, "archive_id", "left_semi")


def parse_archives(archives: DataFrame, files: DataFrame, profiles: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes) of files given as rows (relative_path, length, sha256, content), however many: the same steps, without storing what lies between them."""
    admitted = admit(archives, files, profiles)
    checked = parse_lines(admitted, lines(files.select("relative_path", "content")).hint("merge"), max_line_bytes)
    outcomes = outcomes_of(admitted, checked)
    return documents_of(checked, outcomes), outcomes


def cut_batch(outcomes: DataFrame, max_documents: int) -> DataFrame:
    """Outcomes of one batch: a file beyond the limit alone fails, and the batch ends before the file that would exceed it.

    The first archive left out is found from sums by range of the key, at most
    4096 of them, narrowed down to one key; no task sorts the whole table. Each
    step evaluates outcomes again, so an expensive one is persisted before.
    """
    alone = F.col("document_count") > max_documents
    o = outcomes.withColumns({"failure_code": F.when(alone, "DOCUMENT_LIMIT_EXCEEDED").otherwise(F.col("failure_code")), "document_count": F.when(alone, 0).otherwise(F.col("document_count"))})
    low, high = o.agg(F.min("archive_id"), F.max("archive_id")).first()
    spent = 0
    while low is not None:
        width = -(-(high - low + 1) // 4096)
        part = F.expr(f"(archive_id - {low}L) div {width}L")
        sums = o.where(F.col("archive_id").between(low, high)).groupBy(part.alias("r")).agg(F.sum("document_count").alias("s")).collect()
        for r, s in sorted(sums):
            if spent + (s or 0) > max_documents:
                break
            spent += s or 0
        else:
            return o
        low += r * width
        if width == 1:
            return o.where(F.col("archive_id") < low)
        high = low + width - 1
    return o


def batch_summary(outcomes: DataFrame) -> DataFrame:
    bad = F.col("failure_code").isNotNull()
    return outcomes.agg(F.count("*").alias("source_files"), F.count_if(~bad).alias("parsed_files"), F.count_if(bad).alias("failed_files"), F.coalesce(F.sum("document_count"), F.lit(0)).cast("long").alias("documents"))
