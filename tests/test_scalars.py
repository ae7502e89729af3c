import base64
import datetime as dt
import hashlib
import hmac
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def text(spark, s, f):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


def instants():
    """Random instants written in random offsets, and the same with one part put out of range."""
    rng, good, bad = random.Random(31), [], []
    for _ in range(40):
        ms = rng.randrange(-2_000_000_000_000, 4_000_000_000_000)
        minutes = rng.choice([None, 0, rng.randrange(-840, 841)])
        at = dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=ms)
        zone = "Z" if minutes is None else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
        local = at.astimezone(dt.timezone(dt.timedelta(minutes=minutes or 0)))
        day, clock = local.strftime("%Y-%m-%d"), f"{local:%H:%M:%S}.{local.microsecond // 1000:03d}"
        good.append((f"{day}T{clock}{zone}", ms))
        bad += [f"{day}T{clock[:8]}{zone}", f"{day} {clock}{zone}", f"{day}T{clock}", f"{day}T{clock}0{zone}", f"{local.year}-13-{day[8:]}T{clock}{zone}", f"{local.year}-04-31T{clock}{zone}", f"{day}T24{clock[2:]}{zone}", f"{day}T{clock[:6]}60{clock[8:]}{zone}", f"{day}T{clock}+14:01", f"{day}T{clock}-09:60", f"{day}T{clock}{zone}\n"]
        if not (local.year % 4 == 0 and (local.year % 100 or local.year % 400 == 0)):
            bad.append(f"{local.year}-02-29T{clock}{zone}")
    return good, [*bad, "", None]


def test_iso(spark):
    good, bad = instants()
    df = spark.createDataFrame([(s, ms) for s, ms in good] + [(s, None) for s in bad], "s string, ms long")
    for r in df.select("s", "ms", S.iso_to_ms(F.col("s")).alias("got")).collect():
        assert r["got"] == r["ms"], r["s"]


def test_iso_format(spark):
    for ms in (0, 7, 951_827_696_789, 4_070_908_800_000):
        at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
        stamp = f"{at:%Y-%m-%d %H:%M:%S}.{at.microsecond // 1000:03d}"
        assert value(spark, S.ms_to_iso(F.lit(ms))) == stamp.replace(" ", "T") + "Z" == text(spark, stamp, S.datetime_to_iso)


def test_cursor(spark):
    made = lambda ms, i: base64.urlsafe_b64encode(struct.pack(">qq", ms, i)).decode().rstrip("=")
    for ms, i in ((1, 1), (1_927_000_000_123, 77), (2**63 - 1, 2**62 + 5)):
        assert value(spark, S.cursor_encode(F.lit(ms), F.lit(i))) == made(ms, i)
        assert tuple(text(spark, made(ms, i), S.cursor_decode)) == (ms, i)
    for bad in ("abc", "?" * 22, made(0, 9), made(9, 0), made(-1, 9), made(7, 7)[:-1] + "B", made(7, 7) + "\n", None):
        assert text(spark, bad, S.cursor_decode) is None


def test_tokens(spark):
    said = "Pump_3 STOPPED: axis=Z-09, 温度 too-High; stopped"
    assert text(spark, said, S.tokens) == S.tokens_of(said) == ["pump_3", "stopped", "axis", "z-09", "温度", "too-high", "stopped"]
    assert text(spark, "É a.b", S.tokens) == S.tokens_of("É a.b") == ["É", "a", "b"]
    assert text(spark, "", S.tokens) == []


def test_bitmap(spark):
    bits = [value(spark, S.chunk_done(F.unhex(F.lit("A1")), F.lit(i))) for i in (0, 1, 2, 7, 8, -1)]
    assert bits == [True, False, True, True, False, False]


def test_chunks(spark):
    size, c = F.lit(2_300_000), F.lit(1 << 20)
    assert value(spark, S.chunk_count(size, c)) == 3
    assert [value(spark, S.chunk_length(size, c, F.lit(i))) for i in (0, 2, 3)] == [1 << 20, 202_848, None]


def test_doc_id(spark):
    assert value(spark, S.doc_id(F.lit(7), F.lit(1))) == 30064771073
    assert value(spark, S.doc_id(F.lit(1 << 31), F.lit(1))) is None
    assert value(spark, S.batch_of(F.lit(30064771073))) == 7 and value(spark, S.local_of(F.lit(30064771073))) == 1


@pytest.mark.parametrize("s,x", [("1.5", 1.5), (" 2", 2.0), ("-3e2", -300.0), ("1d", None), ("NaN", None), ("inf", None), ("1e999", None), ("1 ", None), ("1e-400", None), ("0.0", 0.0), (".5", 0.5), ("", None), ("1.5\n", None), ("0x10", 16.0), ("-0X1.8", -1.5), ("0x1p-2", 0.25), ("0x0", 0.0), ("0x", None)])
def test_finite_number(spark, s, x):
    assert text(spark, s, S.finite_number) == x


@pytest.mark.parametrize("s,x", [("0", 0), ("18446744073709551615", 18446744073709551615), ("18446744073709551616", None), ("-1", None), ("", None), ("007", 7), ("1" * 30, None)])
def test_unsigned(spark, s, x):
    got = text(spark, s, S.unsigned)
    assert (None if got is None else int(got)) == x


def test_hmac(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        got = spark.createDataFrame([(bytearray(key), "v1\nGET\né")], "k binary, m string").select(S.hmac_sha256(F.col("k"), F.col("m")).alias("h")).first()["h"]
        assert got == hmac.new(key, "v1\nGET\né".encode(), hashlib.sha256).hexdigest()


def test_names(spark):
    assert text(spark, "a.TXT", S.extension) == "txt"
    assert [text(spark, s, S.extension) for s in (".txt", "a.", "a")] == [None] * 3
    assert [text(spark, s, S.is_file_name) for s in ("a", "a/b", "", "x" * 256)] == [True, False, False, False]
    assert [text(spark, s, S.is_identifier) for s in ("A1", "a1", "A", "A" * 65, "AB\n")] == [True, False, False, False, False]
    assert text(spark, "a b~*é", S.percent_encode) == "a%20b~%2A%C3%A9"
    assert value(spark, S.backoff(F.lit(5), F.lit(500), F.lit(6000))) == 6000


def test_utf8(spark):
    rows = spark.createDataFrame([(bytearray(b"\xc0\xaf"),), (bytearray("é".encode()),)], "b binary")
    assert [r[0] for r in rows.select(S.is_utf8(F.col("b").cast("string"))).collect()] == [False, True]


def test_ends_are_ends(spark):
    uuid = value(spark, S.new_uuid())
    assert text(spark, uuid, S.is_uuid) and not text(spark, uuid + "\n", S.is_uuid)
    assert not text(spark, "AB\n", lambda c: S.is_printable(c, 9)) and text(spark, "12\n", S.unsigned) is None and text(spark, "2031-02-03 04:05:06.007\n", S.datetime_to_iso) is None
    assert text(spark, "2031-02-03T04:05:06.007Z\n", S.iso_to_ms) is None


def test_request_ids_and_parameters(spark):
    assert value(spark, S.sequenced_request_id(F.lit(1_927_000_000_123_456), F.lit(255))) == f"srv-{1_927_000_000_123_456:016x}-000000ff"
    assert len(value(spark, S.random_request_id())) == 32
    q = "a=1&keyword=x%20y+z&b=&keyword=second&bad=%zz"
    assert [text(spark, q, lambda c, n=n: S.query_value(c, n)) for n in ("keyword", "a", "b", "c", "bad")] == ["x y z", "1", "", None, None]
