"""Column functions of the log and archive domain, all built from Spark's own.

Nulls give nulls unless a docstring says otherwise. Sizes and limits are bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whole-string shape of a timestamp: three fractional digits, Z or an offset of at most 14:00.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)\z"
IDENTIFIER = r"^[A-Z0-9_-]{2,64}\z"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
#: The file extensions that each file type allows.
EXTENSIONS = {
    "DETECTION_RESULT": ("json", "csv"),
    "TEST_REPORT": ("csv",),
    "NG_IMAGE": ("png", "jpg", "jpeg"),
    "DEVICE_EXPORT": ("zip", "pdf"),
    "RUNTIME_LOG": ("log", "txt"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, even where a lambda uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits, _ and -, or of any non-ASCII character; A-Z lower-cased, repeats kept.

    ``lower`` does the same on pure ASCII, and faster.
    """
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, r"[^a-z0-9_\-\x{80}-\x{10FFFF}]+"), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    """The same rule for a query keyword on the driver."""
    low = text.translate({ord(u): l for u, l in zip(UPPER, LOWER, strict=True)})
    return [t for t in re.split(r"[^a-z0-9_\-\x80-\U0010FFFF]+", low) if t]


def iso_to_ms(text: Column) -> Column:
    """Epoch milliseconds of a strict timestamp; null where its shape, calendar day, time or offset is invalid."""
    return F.when(text.rlike(ISO_SHAPE), F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))))


def ms_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ms_to_datetime(ms: Column) -> Column:
    """Space-separated form of a database datetime in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def datetime_to_iso(text: Column) -> Column:
    """ISO form of a database datetime of exactly three fractional digits; null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\z"), F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))


def cursor_encode(ms: Column, row_id: Column) -> Column:
    """22 characters of base64url over two big-endian 64-bit numbers; null unless both are positive."""
    hexed = F.concat(F.lpad(F.hex(ms.cast("long")), 16, "0"), F.lpad(F.hex(row_id.cast("long")), 16, "0"))
    return F.when((ms > 0) & (row_id > 0), F.rtrim(F.translate(F.base64(F.unhex(hexed)), "+/", "-_"), F.lit("=")))


def cursor_decode(cursor: Column) -> Column:
    """(ms, id), null for a wrong length or alphabet, unused bits, zero or a number beyond 63 bits."""
    raw = F.hex(F.unbase64(F.concat(F.translate(F.when(cursor.rlike(r"^[A-Za-z0-9_-]{21}[AQgw]\z"), cursor), "-_", "+/"), F.lit("=="))))
    half = lambda at: F.when(F.substring(raw, at, 1) < "8", F.conv(F.substring(raw, at, 16), 16, 10).cast("long"))
    ms, row_id = half(1), half(17)
    return F.when((ms > 0) & (row_id > 0), F.struct(ms.alias("ms"), row_id.alias("id")))


def doc_id(batch_id: Column, local_id: Column) -> Column:
    """batch in the high, position in the low 32 bits; null where the batch would overflow a signed long."""
    return F.when((batch_id >= 0) & (batch_id < (1 << 31)) & (local_id >= 0) & (local_id < (1 << 32)), F.shiftleft(batch_id.cast("long"), 32).bitwiseOR(local_id.cast("long")))


def batch_of(doc: Column) -> Column:
    return F.shiftrightunsigned(doc, 32)


def local_of(doc: Column) -> Column:
    return doc.bitwiseAND(F.lit((1 << 32) - 1))


def chunk_count(size: Column, chunk: Column) -> Column:
    return F.when((size > 0) & (chunk > 0), F.floor((size + chunk - 1) / chunk))


def chunk_length(size: Column, chunk: Column, number: Column) -> Column:
    """Length of a numbered chunk: the last is the remainder; null outside."""
    n = chunk_count(size, chunk)
    return F.when((number >= 0) & (number < n - 1), chunk).when(number == n - 1, size - chunk * (n - 1)).cast("long")


def chunk_done(bitmap: Column, number: Column) -> Column:
    """Bit of a chunk in a bitmap whose bytes are read from the most significant bit; false outside."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(number / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    inside = (number >= 0) & (number < F.octet_length(bitmap) * 8)
    return F.coalesce(F.when(inside, F.getbit(byte, (7 - F.pmod(number, F.lit(8))).cast("int")) == 1), F.lit(False))


def backoff(attempt: Column, base: Column, most: Column, cap: int = 20) -> Column:
    """base doubled with each attempt after the first, up to most; the exponent is capped."""
    return F.least(base * F.pow(F.lit(2.0), F.least(attempt, F.lit(cap)) - 1), most).cast("long")


def task_id(path: Column, device: Column, size: Column, mtime: Column, sha: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, device, size.cast("string"), mtime.cast("string"), sha), 256)


def failed_task_id(path: Column, device: Column, mtime: Column) -> Column:
    return F.sha2(F.concat(path, device, mtime.cast("string")), 256)


def archive_path(ms: Column, line: Column, station: Column, device: Column, kind: Column, upload: Column, extension: Column) -> Column:
    day = F.date_format(F.timestamp_millis(ms), "yyyy/MM/dd")
    return F.concat(F.concat_ws("/", day, line, station, device, kind, upload), F.lit("."), extension)


def is_identifier(text: Column) -> Column:
    return text.rlike(IDENTIFIER)


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


def is_file_name(text: Column) -> Column:
    return (F.octet_length(text).between(1, 255)) & ~text.rlike(r"[\x00-\x1f\x7f/\\]")


def extension(name: Column) -> Column:
    """Lower-cased extension; null for none, a leading dot only, or a trailing dot."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1)), F.lit(""))


def extension_allowed(name: Column, kind: Column) -> Column:
    ok = F.lit(False)
    for k, allowed in EXTENSIONS.items():
        ok = ok | ((kind == k) & extension(name).isin(*allowed))
    return F.coalesce(ok, F.lit(False))


def is_complete(kind: Column, product_sn: Column, result: Column) -> Column:
    """Results and reports need a serial number and a result, images also the result NG."""
    both = (F.coalesce(product_sn, F.lit("")) != "") & result.isin("PASS", "NG")
    return F.coalesce(F.when(kind.isin("DETECTION_RESULT", "TEST_REPORT"), both).when(kind == "NG_IMAGE", both & (result == "NG")).otherwise(True), F.lit(False))


def is_text(text: Column, most: int) -> Column:
    """Not empty, at most so many bytes, no control byte."""
    return F.octet_length(text).between(1, most) & ~text.rlike(r"[\x00-\x1f\x7f]")


def is_printable(text: Column, most: int) -> Column:
    return F.octet_length(text).between(1, most) & text.rlike(r"^[\x20-\x7e]+\z")


def unsigned(text: Column) -> Column:
    """A decimal of at most 64 unsigned bits, as decimal(20); null for signs, spaces or overflow."""
    value = F.when(text.rlike(r"^[0-9]+\z"), F.expr("1") * 0 + F.try_to_number(F.lpad(F.regexp_replace(text, "^0+(?=.)", ""), 20, "0"), F.lit("0" * 20)))
    return F.when(F.length(F.regexp_replace(text, "^0+(?=.)", "")) <= 20, F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value.cast("decimal(20,0)")))


_HEX_DIGITS = r"0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)"
_NUMBER = rf"^[ \t\n\x0B\f\r]*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|{_HEX_DIGITS}(?:[pP][+-]?\d+)?)\z"
_ZERO = r"^[ \t\n\x0B\f\r]*[+-]?(?:(?:0+\.?0*|\.0+)(?:[eE][+-]?\d+)?|0[xX](?:0+\.?0*|\.0+)(?:[pP][+-]?\d+)?)\z"


def finite_number(text: Column) -> Column:
    """A double that takes the whole text, hexadecimal with or without an exponent too; null for infinities, NaN, over- and underflow and trailing characters."""
    bare = text.rlike(rf"{_HEX_DIGITS}\z")
    value = F.when(text.rlike(_NUMBER), F.when(bare, F.concat(text, F.lit("p0"))).otherwise(text).try_cast("double"))
    return F.when((F.abs(value) < float("inf")) & ((F.abs(value) >= 2.2250738585072014e-308) | text.rlike(_ZERO)), value)


def percent_encode(text: Column) -> Column:
    """Everything but letters, digits, -, ., _ and ~ as %XX of its UTF-8 bytes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_request(method: Column, path: Column, device: Column, stamp: Column, request: Column, sha: Column) -> Column:
    return F.concat_ws("\n", F.lit("v1"), method, path, device, stamp, request, sha)


def hmac_sha256(key: Column, message: Column) -> Column:
    """Lower hex HMAC-SHA256, from sha2 and bytewise xor of the padded key in hex digits; key is binary, message text."""
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    padded = F.rpad(F.hex(short), 128, "0")

    def keyed(pad: int) -> Column:
        byte = lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(pad))), 2, "0")
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), byte), ""))

    inner = F.sha2(F.concat(keyed(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(keyed(0x5C), F.unhex(inner)), 256)


def same_digest(a: Column, b: Column) -> Column:
    """Equality by digests, so that time depends on neither's first difference."""
    return F.sha2(a, 256) == F.sha2(b, 256)


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def levels_split(text: Column) -> Column:
    """Comma split that keeps empty parts, which later checks reject."""
    return F.split(text, ",")


def new_uuid() -> Column:
    """A fresh lower-case version 4 UUID in each row."""
    return F.expr("uuid()")


def sequenced_request_id(us: Column, number: Column) -> Column:
    """``srv-``, 16 hex digits of the microseconds, and 8 or more of a running number."""
    at_least = lambda c, n: F.when(F.length(F.hex(c)) < n, F.lpad(F.hex(c), n, "0")).otherwise(F.hex(c))
    return F.concat(F.lit("srv-"), F.lower(at_least(us.cast("long"), 16)), F.lit("-"), F.lower(at_least(number.cast("long"), 8)))


def random_request_id() -> Column:
    """128 random bits as 32 hex digits."""
    return F.md5(F.concat(F.expr("uuid()"), F.expr("uuid()")))


def query_value(query: Column, name: str) -> Column:
    """Decoded value of the first parameter of a name in a query string; null where it is missing or not decodable."""
    part = F.get(F.filter(F.split(query, "&"), lambda x: x.startswith(name + "=")), F.lit(0))
    return F.try_url_decode(F.substring(part, F.lit(len(name) + 2), F.length(part)))
