"""Source divergence audit by sorted streams: how far the sources of a language differ in their words, and which words tell.

First pass: documents are counted where they lie, in blocks; rows (lang, term,
source, block, documents, occurrences) are dealt by (lang, term), sorted, and a
run-length scan adds up equal neighbours. A term's runs lie together, so the
scan knows its document frequency when the term ends, and writes the counts of
kept terms. Second pass: the counts meet the totals of their group and are
dealt and sorted once more; a scan emits, for each run of terms, partial sums
by pair of sources and the leading terms of each source.

A sum over all kept terms needs no pass over absent terms. With A the terms of
source a, B those of b, and a0, b0 their shares of an absent term, it is
  sum over A and B of f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
  + sum over A of f(a, b0) + sum over B of f(a0, b) + (V - |A| - |B|) f(a0, b0),
and the sums over A or B alone follow from how often each count occurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, scratch, stored

#: A-Z to a-z; every other ASCII character that is no letter to a space; bytes of other characters as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at once, entries of a block, pairs held before they are added up, terms held for a top list.
PIECE, BLOCK, PAIRS, TERMS = 1 << 22, 300_000, 1 << 20, 100_000

PARTIAL = "lang string, term string, source string, block long, df long, n long"
COUNTS = "lang string, term string, source string, n long"
RESULT = "part string, lang string, source string, item string, value long"


def _words(text: bytes) -> Iterator[list[bytes]]:
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = len(folded)
        if end - start > PIECE:
            end = folded.rfind(b" ", start, start + PIECE) + 1 or folded.find(b" ", start + PIECE) + 1 or end
        yield folded[start:end].split()
        start = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term) over blocks of whole documents; a row's block is unique in the job."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: dict = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for (lang, source), (df, n) in held.items():
            terms = sorted(n)
            size = len(terms)
            columns = [pa.array([lang] * size, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([source] * size, pa.string()), pa.array([number] * size, pa.int64()), pa.array([df[t] for t in terms], pa.int64()), pa.array([n[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "block", "df", "n"])
        held.clear()
        number += 1

    for b in batches:
        langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            df, n = held[lang, source]
            seen: set[bytes] = set()
            for words in _words(text.as_py()):
                n.update(words)
                seen.update(words)
            df.update(seen)
        if sum(len(n) for _, n in held.values()) > BLOCK:
            yield from rows()
    yield from rows()


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns])
    return np.flatnonzero(new)


def _chunk(b: pa.RecordBatch, carry: pa.Table | None) -> pa.Table:
    """What was carried over and a batch, as one chunk."""
    t = pa.Table.from_batches([b])
    return t if carry is None else pa.concat_tables([carry, t]).combine_chunks()


def _columns(t: pa.Table, *names: str) -> list[pa.Array]:
    """Columns of a table whose rows are one chunk."""
    return [t.column(n).chunk(0) for n in names]


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut where a term ends: a table of whole terms and the row where each begins."""
    carry = None
    for b in batches:
        t = _chunk(b, carry)
        if not t.num_rows:
            continue
        starts = _starts(_columns(t, "lang", "term"))
        carry = t.slice(int(starts[-1]))
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks(), np.zeros(1, np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums of neighbours equal in (lang, term, source), batch by batch: a run may show again in the next batch."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            starts = _starts(_columns(t, "lang", "term", "source"))
            firsts = t.select(["lang", "term", "source"]).take(pa.array(starts)).combine_chunks()
            sums = [pa.array(np.add.reduceat(c.to_numpy(), starts)) for c in _columns(t, "df", "n")]
            yield from pa.Table.from_arrays([*firsts.columns, *sums], names=["lang", "term", "source", "df", "n"]).to_batches()


def _count_runs(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _by_term(_summed(batches)):
            t = pa.Table.from_batches(_summed(iter(t.to_batches())))
            starts = _starts(_columns(t, "lang", "term"))
            df = np.add.reduceat(t.column("df").to_numpy(), starts)
            keep = np.repeat(df >= min_docs, np.diff([*starts, t.num_rows]))
            yield from t.select(["lang", "term", "source", "n"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _share(count: np.ndarray, among: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / among) without leaving 64 bits: 10^9 is 31250 times 32000."""
    top = 31_250 * (count + 2)
    return 1 + 32_000 * (top // among) + 32_000 * (top % among) // among


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Pairs:
    """Sums by pair of numbers, held up to PAIRS entries."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(a << 32 | b)
        self.values.append(value)
        self.held += len(a)

    def fold(self) -> None:
        if len(self.keys) > 1:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate(self.values))
            self.keys, self.values, self.held = [keys], [sums], len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.fold()
        keys, values = (self.keys + [np.zeros(0, np.int64)])[0], (self.values + [np.zeros(0, np.int64)])[0]
        self.__init__()
        return keys >> 32, keys & 0xFFFFFFFF, values


def _score_runs(top: int):
    """For whole terms: partial sums of the pairs of sources that share them, and the leading terms of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        pairs, best = _Pairs(), None

        def number(lang: str, source: str) -> int:
            if (lang, source) not in groups:
                groups[lang, source] = len(names)
                names.append((lang, source))
            return groups[lang, source]

        def pair_rows() -> Iterator[pa.RecordBatch]:
            a, b, value = pairs.take()
            columns = [["pair"] * len(a), [names[i][0] for i in a], [names[i][1] for i in a], [names[i][1] for i in b], value]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4])], names=["part", "lang", "source", "item", "value"])

        def leading(t: pa.Table) -> pa.Table:
            """The first ``top`` rows of each group by value, then term."""
            t = t.sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
            starts = _starts(_columns(t, "lang", "source"))
            rank = np.arange(t.num_rows) - np.repeat(starts, np.diff([*starts, t.num_rows]))
            return t.filter(pa.array(rank < top))

        for t, starts in _by_term(batches):
            n, among, among_all = (t.column(c).to_numpy() for c in ("n", "among", "among_lang"))
            sizes = np.diff([*starts, t.num_rows])
            p, p0 = _share(n, among), _share(np.zeros_like(n), among)
            q = np.repeat(_share(np.add.reduceat(n, starts), among_all[starts]), sizes)
            told = np.flatnonzero(p > q)
            part = pa.Table.from_arrays([*t.select(["lang", "source", "term"]).take(pa.array(told)).columns, pa.array(_f(p[told], q[told]))], names=["lang", "source", "item", "value"])
            best = part if best is None else pa.concat_tables([best, part])
            if best.num_rows > TERMS:
                kept = leading(best)
                if kept.num_rows > TERMS // 2:
                    yield from _terms(kept)
                    kept = None
                best = kept
            ids = np.fromiter(map(number, *(t.column(c).to_pylist() for c in ("lang", "source"))), np.int64, t.num_rows)
            for start, size in zip(starts, sizes, strict=True):
                # rows of the triangle above the diagonal, as many at once as PAIRS allows
                step = max(1, PAIRS // int(size))
                for low in range(0, int(size) - 1, step):
                    i, j = np.triu_indices(min(step, int(size) - low), 1, int(size) - low)
                    i, j = i + start + low, j + start + low
                    pairs.add(ids[i], ids[j], _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j]))
                    if pairs.held > PAIRS:
                        pairs.fold()
                        if pairs.held > PAIRS // 2:
                            yield from pair_rows()
        yield from pair_rows()
        if best is not None and best.num_rows:
            yield from _terms(leading(best))

    return run


def _terms(t: pa.Table) -> list[pa.RecordBatch]:
    named = pa.Table.from_arrays([pa.array(["term"] * t.num_rows, pa.string()), *t.select(["lang", "source", "item", "value"]).columns], names=["part", "lang", "source", "item", "value"])
    return named.combine_chunks().to_batches()


def _share_column(count: Column, among: Column) -> Column:
    div = lambda a, b: F.call_function("div", a, b)
    top, among = (count + 2) * 31_250, F.nullif(among, F.lit(0).cast("long"))
    return F.lit(1).cast("long") + div(top, among) * 32_000 + div((top % among) * 32_000, among)


def _f_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every other source of the language by divergence, and the leading terms.

    Null texts, languages and sources are empty strings, which are a language
    and a source like others; each row is a document, so repeated rows count
    each time. Groups without terms, and languages whose kept terms number none,
    get their pairs too, with value 0 in the latter. Equal values are ordered by
    item. A very long text is split in pieces within its task. Counts are exact
    up to 10^14 occurrences of a term. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = scratch(spark)
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    dealt = plain.mapInArrow(_blocks, PARTIAL).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    counts = stored(dealt.mapInArrow(_count_runs(min_docs), COUNTS), f"{base}/counts")

    # a row for each group, with the totals of group and language and how often each count occurs
    often = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("c"))
    own = often.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("c")).alias("total"), F.sum("c").alias("own"), F.collect_list(F.struct("n", "c")).alias("often"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", zero("own").alias("own"), zero("v").alias("v"), (zero("total") + 2 * zero("v")).alias("among"), (zero("all") + 2 * zero("v")).alias("among_lang"), F.coalesce("often", F.array().cast("array<struct<n:bigint,c:bigint>>")).alias("often"))
    groups = stored(groups, f"{base}/groups")

    runs = counts.join(groups.select("lang", "source", "among", "among_lang"), ["lang", "source"])
    runs = runs.select("lang", "term", "source", "n", "among", "among_lang").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    partial = stored(runs.mapInArrow(_score_runs(top), RESULT), f"{base}/partial")

    both = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("shared"))
    side = lambda s: groups.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in ("source", "own", "among", "often")], *([F.col("v")] if s == "a" else []))
    absent = lambda s: _share_column(F.lit(0).cast("long"), F.col(f"{s}_among"))
    alone = lambda s, o: F.aggregate(F.col(f"{s}_often"), F.lit(0).cast("long"), lambda sum_, x: sum_ + x["c"] * _f_column(_share_column(x["n"], F.col(f"{s}_among")), F.col(f"{o}_absent")))
    pairs = side("a").join(side("b"), "lang").where("a_source < b_source").withColumns({"a_absent": absent("a"), "b_absent": absent("b")})
    rest = alone("a", "b") + alone("b", "a") + (F.col("v") - F.col("a_own") - F.col("b_own")) * _f_column(F.col("a_absent"), F.col("b_absent"))
    # without kept terms nothing is among them, and shares are null
    valued = pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), rest.alias("rest")).join(both, ["lang", "source", "item"], "left")
    valued = valued.select("lang", "source", "item", (F.coalesce("rest", F.lit(0)) + F.coalesce("shared", F.lit(0))).alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pair_rows = valued.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    term_rows = partial.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pair_rows.withColumn("rank", F.row_number().over(order))
    return ranked.union(term_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, g.v, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM s),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q FROM s GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
