"""Block-max postings: a term's postings in ranges of document ids, each with a bound on what it can score.

A row is (term, block, ids, tfs, lens, n, max_tf, min_len): the documents of one
range of 256 ids that hold the term, in order, how often, and how long they
are. BM25 grows with the count and falls with the length, so max_tf and min_len
bound the score of every document in the row. A search for the best k reads the
bounds of the query's terms first, scores the most promising ranges, and then
only those ranges whose bound reaches the k-th score found. Counts and
intersections read ids alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens

K1, B = 1.2, 0.75
#: A block holds ids that are equal but for so many low bits.
BLOCK_BITS = 8
#: Ranges that are scored first, at least.
FIRST_BLOCKS = 16
#: Bytes of text whose words one task counts.
PART_BYTES = 16 << 20


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, weight: Column | float, average: Column | float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """Blocks of documents, at most 256 entries a row.

    Texts are exchanged once, by ranges of ids and in parts of bounded bytes, so
    that a block lies in one part: words are counted and gathered there, and no
    posting is exchanged, which would take several times the texts' room.
    """
    some = docs.select(F.col(key).alias("id"), F.shiftright(F.col(key), BLOCK_BITS).alias("block"), F.col(text).alias("text"))
    size = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = some.repartitionByRange(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)), "block")
    words = dealt.select("id", "block", tokens(F.col("text")).alias("w")).select("id", "block", F.size("w").alias("len"), F.explode("w").alias("term"))
    return _gathered(words.groupBy("block", "term", "id", "len").agg(F.count("*").alias("tf")))


def of_postings(posts: DataFrame) -> DataFrame:
    """Blocks of rows (term, id, tf, len)."""
    return _gathered(posts.withColumn("block", F.shiftright("id", BLOCK_BITS)))


def _gathered(posts: DataFrame) -> DataFrame:
    one = F.struct("id", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))
    rows = posts.groupBy("term", "block").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return rows.select("term", "block", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.len").alias("min_len"))


def write(blocks: DataFrame, path: str, by_term: bool = True) -> None:
    """Sorted by term, so that a query reads its terms' row groups, which a bloom filter names; not by_term: in each part as it lies, where a query reads its terms' pages of every file."""
    (blocks.repartitionByRange("term") if by_term else blocks).sortWithinPartitions("term", "block").write.mode("error").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def frequencies(blocks: DataFrame, terms: list[str]) -> dict[str, int]:
    """Document frequency of the terms that occur, from the counts of the blocks."""
    return {r["term"]: r["df"] for r in blocks.where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("n").alias("df")).collect()}


def matching_ids(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """(block, ids) of the documents that hold every term: arrays of one range are intersected inside a row, no posting is a row of its own."""
    held = blocks.where(F.col("term").isin(*terms)).select("block", "ids")
    both = held.groupBy("block").agg(F.collect_list("ids").alias("all")).where(F.size("all") == len(set(terms)))
    return both.select("block", F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), F.array_intersect).alias("ids"))


def count_hits(blocks: DataFrame, terms: list[str]) -> DataFrame:
    return matching_ids(blocks, terms).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("total_hits"))


def documents_with(blocks: DataFrame, terms: list[str]) -> DataFrame:
    return matching_ids(blocks, terms).select(F.explode("ids").alias("doc_id"))


def scores(blocks: DataFrame, terms: list[str], n: int, average: float, df: dict[str, int]) -> DataFrame:
    """(doc_id, bm25) of the documents that hold every term in blocks that hold it; the sum is taken in term order, whatever the plan."""
    terms = sorted(set(terms))
    p = blocks.where(F.col("term").isin(*terms)).select("term", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
    tf = p.groupBy(F.col("p.ids").alias("doc_id"), F.col("p.lens").alias("len")).agg(*[F.max(F.when(F.col("term") == t, F.col("p.tfs"))).alias(f"__tf{i}") for i, t in enumerate(terms)])
    hit = tf.where(" AND ".join(f"__tf{i} IS NOT NULL" for i in range(len(terms))))
    score = sum((term_score(F.col(f"__tf{i}"), F.col("len"), idf(n, df[t]), average) for i, t in enumerate(terms)), F.lit(0.0))
    return hit.select("doc_id", score.alias("bm25"))


def bounds(blocks: DataFrame, terms: list[str], n: int, average: float, df: dict[str, int]) -> DataFrame:
    """(block, bound): the most that a document of a range can score, of the ranges that hold every term."""
    weight = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, idf(n, df[t]))]), F.col("term"))
    part = term_score(F.col("max_tf"), F.col("min_len"), weight, average)
    rows = blocks.where(F.col("term").isin(*terms)).select("block", part.alias("part")).groupBy("block").agg(F.count("*").alias("terms"), F.sum("part").alias("bound"))
    return rows.where(F.col("terms") == len(set(terms))).select("block", "bound")


def best(blocks: DataFrame, terms: list[str], n: int, average: float, k: int, df: dict[str, int] | None = None, keep: DataFrame | None = None, extra: Column | None = None, most_extra: float = 0.0) -> DataFrame:
    """(doc_id, bm25) that hold the k best documents, ties included: all others score less than k of these.

    ``keep`` has the documents that count, with whatever ``extra``, at most
    most_extra, is made of; extra is added to the score that ranks.
    """
    terms = sorted(set(terms))
    df = frequencies(blocks, terms) if df is None else df
    if any(t not in df for t in terms):
        return blocks.select(F.col("block").alias("doc_id"), F.lit(0.0).alias("bm25")).limit(0)
    ranges = bounds(blocks, terms, n, average, df)
    ranked = lambda some: scores(blocks.where(F.col("block").isin(some)), terms, n, average, df)
    first = [r["block"] for r in ranges.orderBy(F.desc("bound"), "block").limit(max(FIRST_BLOCKS, 2 * k >> BLOCK_BITS)).collect()]
    found = ranked(first)
    if keep is not None:
        found = found.join(keep, "doc_id")
    total = F.col("bm25") + (extra if extra is not None else F.lit(0.0))
    top = [r["s"] for r in found.select(total.alias("s")).orderBy(F.desc("s")).limit(k).collect()]
    if len(top) < k:
        return scores(blocks, terms, n, average, df)
    # a little below the k-th score, for sums in another order
    reach = ranges.where(F.col("bound") >= top[-1] - most_extra - 1e-6).select("block")
    return scores(blocks.where(F.col("term").isin(*terms)).join(reach, "block", "left_semi"), terms, n, average, df)


def bitmaps(blocks: DataFrame) -> DataFrame:
    """(term, bucket, bits): a bitmap for each term and 32,768 ids, for terms that many documents hold."""
    ids = blocks.select("term", F.explode("ids").alias("id"))
    return ids.groupBy("term", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def intersected(maps: DataFrame, terms: list[str]) -> DataFrame:
    """(bucket, bits) of the documents that hold every term: an AND of bitmaps inside an aggregation."""
    rows = maps.where(F.col("term").isin(*terms)).groupBy("bucket").agg(F.count("*").alias("terms"), F.expr("bitmap_and_agg(bits)").alias("bits"))
    return rows.where(F.col("terms") == len(set(terms))).select("bucket", "bits")


def members(maps: DataFrame) -> DataFrame:
    """doc_id of the bits that are set; only bytes that have one are looked into."""
    codes = F.transform(F.split(F.regexp_replace(F.hex("bits"), "(..)", "$1 "), " "), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    byte = maps.select("bucket", F.explode(F.filter(codes, lambda x: (x["h"] != "00") & (x["h"] != ""))).alias("x"))
    bit = byte.select("bucket", (F.col("x.i") * 8).alias("at"), F.conv("x.h", 16, 10).cast("int").alias("v")).select("bucket", "at", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    at, bucket = F.col("at") + F.col("b"), F.col("bucket")
    # buckets above 0 count up from 1, the others down from 0
    return bit.where(F.getbit("v", F.col("b")) == 1).select(F.when(bucket > 0, (bucket - 1) * 32768 + at + 1).otherwise(bucket * 32768 - at).alias("doc_id"))
