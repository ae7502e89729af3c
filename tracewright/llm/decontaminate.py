"""Benchmark decontamination by winnowing, with built-in functions only.

Both sides are winnowed: of the 5-gram hashes in each window of 10 words (6 of
them) the least is selected, the last one on ties, so any passage of 10 words
that a document shares with the benchmark has a selected gram in common at the
same place. In steps:

1. Each document becomes one slim row of its selected grams (place, hash), in
   one pass that needs no exchange. While the benchmark is small enough, a
   bitmap of its fingerprints, a literal of bounded size, drops grams that cannot
   meet before their windows are compared; beyond that size there is none, and
   nothing else changes.
2. The fingerprints are joined with the benchmark's distinct ones. Spark
   broadcasts those if they are small, and exchanges slim rows else.
3. Each hit is extended: the windows around it are compared by their words with
   the benchmark's distinct windows, which makes the result exact. Only
   documents with a hit are read again for that.
4. Windows give spans and items by document; those are joined with the rows of
   step 1, which count the words.

Items shorter than a window are one window of their own length, with grams of
that length where it is below 5; documents are winnowed by those lengths too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, let, read_table, scratch, stored, window_hashes

WINDOW, GRAM = 10, 5
#: 64-bit words of a bitmap, least and most: 8 KB to 512 KB. A benchmark with more fingerprints than an eighth of the bits has no bitmap.
BITMAP_LOW, BITMAP_HIGH = 1 << 10, 1 << 16


def winnow(words: Column, length: int, gram: int, among: Callable[[Column], Column] | None = None) -> Column:
    """(at, fp) of the grams selected from windows of ``length`` words, in order; ``words`` must be bound.

    A gram is selected if some window of grams around it holds none that is
    less, and no equal one behind it. ``among`` narrows the hashes that are
    looked at, before their windows are compared.
    """
    gram = min(gram, length)
    span = length - gram + 1

    def selected(h: Column) -> Column:
        def run(i: Column, way: int) -> Column:
            """How many grams next to i, span - 1 at most, leave it the least."""
            own = F.get(h, i)
            ends = [F.get(h, i + way * d) for d in range(1, span)]
            return F.coalesce(*[F.when(F.coalesce(x < own if way < 0 else x <= own, F.lit(True)), F.lit(d)) for d, x in enumerate(ends)], F.lit(span - 1))

        def chosen(i: Column) -> Column:
            least = run(i, -1) + run(i, 1) >= F.lit(span - 1)
            return among(F.get(h, i)) & least if among else least

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - 1), chosen), lambda i: F.struct(i.alias("at"), F.get(h, i).alias("fp")))

    return F.when(F.size(words) >= length, let(window_hashes(words, gram), selected)).otherwise(F.array().cast("array<struct<at:int,fp:bigint>>"))


def _windows_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, length, win): each distinct window of each item; items without a word have none."""
    n = F.size("w")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return (
        items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("x"))
        .select("item_id", F.size("x").alias("length"), F.array_join("x", " ").alias("win"))
        .distinct()
    )


def _fingerprints(windows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(length, fp): the selected gram of each distinct window of the benchmark."""
    out = None
    for length in lengths:
        fp = windows.where(F.col("length") == length).select("length", F.get(let(F.split("win", " "), lambda w: winnow(w, length, gram)), F.lit(0))["fp"].alias("fp")).distinct()
        out = fp if out is None else out.union(fp)
    return out


def _bitmap(fps: DataFrame, length: int, size: int) -> list[int]:
    """Words of the bitmap of one length, aggregated on the executors; at most ``size`` rows come to the driver."""
    mine = fps.where(F.col("length") == length)
    rows = mine.groupBy(_slot(F.col("fp"), size).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("fp")))).alias("b")).collect()
    bits = [0] * size
    for r in rows:
        bits[r["i"]] = r["b"]
    return bits


def _slot(fp: Column, size: int) -> Column:
    return F.shiftrightunsigned(fp, 6).bitwiseAND(F.lit(size - 1)).cast("int")


def _bit(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(63)).cast("int")


def _seen(fp: Column, size: int, bits: list[int]) -> Column:
    table = F.expr(f"array({', '.join(f'{b}L' if b > -(1 << 63) else 'bigint(-9223372036854775808)' for b in bits)})")
    return F.getbit(F.get(table, _slot(fp, size)), _bit(fp)) == 1


def hit_windows(docs: DataFrame, items: DataFrame, base: str, window: int = WINDOW, gram: int = GRAM, bitmap_words: int = BITMAP_HIGH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, windows): every row of docs with ``n_words``; each occurrence (start, length, win) of a benchmark window; (item_id, length, win) of the benchmark.

    ``docs`` must have a column ``key`` and ``text``; equal keys must have equal
    words. bitmap_words bounds the bitmap, 0 leaves it out.
    """
    windows = stored(_windows_of(items, window), f"{base}/windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    if not lengths:
        rows = docs.select("key", F.size(alnum_words(F.col("text"))).alias("n_words"))
        return rows, rows.limit(0).select("key", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("win")), windows
    fps = stored(_fingerprints(windows, lengths, gram), f"{base}/prints")
    n, size = fps.count(), BITMAP_LOW
    while size < bitmap_words and size < n:
        size *= 2
    maps = {length: _bitmap(fps, length, size) for length in lengths} if 8 * n <= 64 * size <= 64 * bitmap_words else {}

    def chosen(w: Column) -> Column:
        def of(length: int) -> Column:
            own = winnow(w, length, gram, (lambda fp: _seen(fp, size, maps[length])) if maps else None)
            return F.transform(own, lambda x: F.struct(F.lit(length).alias("length"), x["at"].alias("at"), x["fp"].alias("fp")))

        return F.struct(F.size(w).alias("n"), F.concat(*[of(length) for length in lengths]).alias("g"))

    rows = docs.select("key", let(alnum_words(F.col("text")), chosen).alias("c")).select("key", F.col("c.n").alias("n_words"), F.col("c.g").alias("grams"))
    rows = stored(rows, f"{base}/rows")
    met = rows.where(F.size("grams") > 0).select("key", F.explode("grams").alias("g")).select("key", "g.length", "g.at", "g.fp").join(fps, ["length", "fp"], "left_semi")
    # a document's own grams: at most as many as it has words
    met = stored(met.groupBy("key").agg(F.collect_set(F.struct("length", "at")).alias("grams")), f"{base}/met")

    def around(w: Column) -> Callable[[Column], Column]:
        """Windows that hold a gram, as length << 32 | start: numbers are told apart by hash, structs by comparing all with all."""

        def starts(x: Column) -> Column:
            own = F.least(F.lit(gram), x["length"])
            low = F.greatest(F.lit(0), x["at"] + own - x["length"])
            high = F.least(x["at"], F.size(w) - x["length"])
            return F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda s: F.shiftleft(x["length"].cast("bigint"), 32) + s)

        return starts

    def with_words(w: Column) -> Callable[[Column], Column]:
        def cut(x: Column) -> Column:
            start, length = x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright(x, 32).cast("int")
            return F.struct(start.alias("start"), length.alias("length"), F.array_join(F.slice(w, start + 1, length), " ").alias("win"))

        return cut

    # only texts with a hit are split again, after the join; repeated rows of a key have equal words, so one of them is enough
    near = docs.join(met, "key").dropDuplicates(["key"])
    near = near.select("key", let(alnum_words(F.col("text")), lambda w: F.transform(F.array_distinct(F.flatten(F.transform("grams", around(w)))), with_words(w))).alias("x"))
    near = near.select("key", F.explode("x").alias("x")).select("key", "x.*")
    hits = near.join(windows.select("length", "win").distinct(), ["length", "win"], "left_semi")
    return rows.select("key", "n_words"), stored(hits.select("key", "start", "length", "win"), f"{base}/hits"), windows


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bitmap_words: int = BITMAP_HIGH) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, spans (start, length of hit windows) and contaminated.

    Null, empty and wordless texts have no words and no hits; wordless items
    occur nowhere. Repeated item rows count once by their id; a null item id
    never counts as an item, though its words are hit. Repeated rows of docs
    each keep their row, also where an id has several texts. An empty
    benchmark leaves every document clean. Other columns are left out.
    """
    t, it = F.col(text_col), F.col(item_text_col)
    # a document is its id and its text: repeated ids stay apart without any stored row number
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(t).alias("h"), F.length(t).alias("n")).alias("key"), t.alias("text"))
    bench = items.select(F.col(item_col).alias("item_id"), alnum_words(it).alias("w"))
    rows, hits, windows = hit_windows(keyed, bench, scratch(docs.sparkSession), window, gram, bitmap_words)
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    met = hits.join(windows, ["length", "win"]).where("item_id IS NOT NULL").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    # the digest names every item, so a document's row must hold them all
    met = met.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    got = rows.join(spans.join(met, "key", "left"), "key", "left")

    def covered(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["start"] + x["length"])
        step = F.aggregate(F.arrays_zip(s.alias("s"), ends.alias("e")), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]["start"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")))
        return step["n"]

    none = F.array().cast("array<string>")
    ids, at = F.coalesce("ids", none), F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>"))
    return got.select(
        F.col("key.id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), let(at, covered).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), at.alias("spans"), (F.size(at) > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate(docs, items).drop("spans")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM s),
p AS (SELECT rid, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= l.n),
h AS (SELECT p.rid, p.i, p.n, win.item_id FROM p JOIN win ON p.n = win.n AND array_to_string(p.w[p.i : p.i + p.n - 1], ' ') = win.win),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
