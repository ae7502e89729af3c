"""Line dedup over levelled sorted runs of line hashes, with built-in functions only.

A line's key is the line without white space at its ends, A-Z lower-cased, as
128 bits of hash. A store keeps runs: tables of (h1, h2, n), bucketed and sorted
by hash, n being the number of documents of the batches behind the run that
hold the key. A key that enough documents hold is settled and moves to runs of
their own, which say nothing more than that. Each new batch is counted,
merge-anti-joined with the settled runs and adds what is left as a run of level
0; FANOUT runs of a level are summed into one of the next, which settles keys.
So a common line costs one row in the whole store, a batch reads the settled
keys and writes its own, and a row is rewritten once a level.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, let, read_table, scratch, stored

#: Batches that the query cuts its table into, and runs of a level that are compacted into one.
BATCHES, FANOUT = 6, 3
HASH = ("h1", "h2")


def _keys(text: Column, min_length: int) -> Column:
    """Of each distinct key of a text: its hashes and the positions of its lines."""

    def grouped(s: Column) -> Column:
        opens = lambda i: (i == 0) | (F.get(s, i)["h1"] != F.get(s, i - 1)["h1"]) | (F.get(s, i)["h2"] != F.get(s, i - 1)["h2"])
        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), opens)).otherwise(F.array().cast("array<int>"))
        positions = lambda b, at, j: F.transform(F.slice(s, at + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - at), lambda x: x["at"])
        return let(starts, lambda b: F.transform(b, lambda at, j: F.struct(F.get(s, at)["h1"].alias("h1"), F.get(s, at)["h2"].alias("h2"), positions(b, at, j).alias("at"))))

    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    hashed = F.transform(keys, lambda x, i: F.when(F.length(x) >= min_length, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), i.alias("at"))))
    return let(F.sort_array(F.array_compact(hashed)), grouped)


def document_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 1) -> DataFrame:
    """A row (r1, r2, h1, h2, at) for each row of docs and distinct key in it; r1 and r2 name the row by its id and text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*_row(id_col, text_col), F.explode(_keys(t, min_length)).alias("k")).select("r1", "r2", "k.h1", "k.h2", "k.at")


def _row(id_col: str, text_col: str) -> list[Column]:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(id_col, t).alias("r1"), F.xxhash64(F.lit(1), F.col(id_col), t).alias("r2")]


class LineRuns:
    """The runs of one store in ``path``, a folder that driver and executors share.

    One process adds to a store. Runs are tables of the session's catalogue over
    files in ``path``; ``close`` forgets the tables and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 10, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.open: dict[int, list[str]] = defaultdict(list)
        self.settled: dict[int, list[str]] = defaultdict(list)
        self.made = 0

    def _write(self, rows: DataFrame, level: int, runs: dict[int, list[str]]) -> None:
        """Adds rows, at most one for each hash, as a sorted run of a level."""
        self.made += 1
        name = f"{self.path.rstrip('/').rpartition('/')[2].replace('-', '_')}_{self.made}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        runs[level].append(name)

    def _all(self, names: list[str]) -> DataFrame:
        """All rows of runs, read as plain files: a union of bucketed tables isn't bucketed."""
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.path}/{n}" for n in names])

    def _unsettled(self, names: list[str]) -> DataFrame:
        """Summed counts of open runs, without the keys that other runs have settled meanwhile."""
        return self._without_settled(self._all(names).groupBy(*HASH).agg(F.sum("n").alias("n")))

    def _without_settled(self, counts: DataFrame) -> DataFrame:
        for name in self._names(self.settled):
            counts = counts.join(self.spark.table(name).hint("merge"), list(HASH), "left_anti")
        return counts

    @staticmethod
    def _names(runs: dict[int, list[str]]) -> list[str]:
        return [n for names in runs.values() for n in names]

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: a row with the hashes for each document and distinct key."""
        counts = keys.groupBy(*HASH).agg(F.count("*").alias("n"))
        self._write(self._without_settled(counts), 0, self.open)
        level = 0
        while len(self.open[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Sums the open runs of a level into one of the next; keys that min_docs documents hold become a settled run."""
        sums = stored(self._unsettled(self.open.pop(level)), f"{self.path}/sums-{self.made}")
        self._write(sums.where(F.col("n") < self.min_docs).repartition(self.buckets, *HASH), level + 1, self.open)
        self._write(sums.where(F.col("n") >= self.min_docs).repartition(self.buckets, *HASH), 0, self.settled)
        at = 0
        while len(self.settled[at]) >= self.fanout:
            self._write(self._all(self.settled.pop(at)).repartition(self.buckets, *HASH), at + 1, self.settled)
            at += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys that min_docs documents of all batches hold: the settled ones and those whose open runs sum to as much."""
        found = self.spark.range(0).select(*[F.lit(0).cast("long").alias(h) for h in HASH])
        if settled := self._names(self.settled):
            found = found.union(self._all(settled).select(*HASH))
        if unsettled := self._names(self.open):
            found = found.union(self._unsettled(unsettled).where(F.col("n") >= self.min_docs).select(*HASH))
        return found

    def close(self) -> None:
        for name in self._names(self.open) + self._names(self.settled):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_lines(docs: DataFrame, keys: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their text rid of the lines whose key is frequent, and n_lines and n_dropped; keys are those of these docs.

    Lines that stay are untouched and joined by line feeds. The join of keys and
    frequent hashes moves hashes and positions; only then do texts meet the
    positions to drop. A frequent key with a large share of all rows is split
    by the adaptive skew join. Columns of docs named n_lines, n_dropped, r1,
    r2 or at are no obstacle: the first two are replaced, the others kept.
    """
    hits = keys.join(frequent, list(HASH)).select("r1", "r2", "h1", "h2", "at")
    # rows equal in id and text have the same lines
    hits = hits.repartition("r1", "r2").dropDuplicates(["r1", "r2", *HASH]).groupBy("r1", "r2").agg(F.flatten(F.collect_list("at")).alias("at"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row(id_col, text_col))
    split = F.split(F.coalesce(F.col("row").getField(text_col), F.lit("")), "\n")
    kept = let(split, lambda x: F.struct(F.size(x).alias("n"), F.when(F.col("at").isNull(), x).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("at")), lambda i: F.get(x, i))).alias("kept")))
    out = held.join(hits, ["r1", "r2"], "left").select("row", kept.alias("k"))
    given = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return out.select(*given, F.array_join("k.kept", "\n").alias(text_col), F.col("k.n").cast("long").alias("n_lines"), (F.col("k.n") - F.size("k.kept")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_length: int = 1, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs rid of every line whose key, of min_length code points or more, min_docs documents hold; with n_lines and n_dropped.

    Every row of docs is a document, repeated rows and null ids too. Null and
    empty texts have one empty line, whose key is too short to go; a null text
    comes back empty. A very long text is one row of one task, in time in
    proportion to its lines but for a sort. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = scratch(spark)
    keys = document_keys(docs, id_col, text_col, min_length).withColumn("batch", F.pmod("r1", F.lit(batches)).cast("int"))
    keys.write.partitionBy("batch").parquet(f"{base}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{base}/keys")
    runs = LineRuns(spark, base, min_docs, fanout=fanout)
    try:
        for b in range(batches):
            runs.add(keys.where(F.col("batch") == b))
        frequent = stored(runs.frequent(), f"{base}/frequent")
    finally:
        runs.close()
    return drop_lines(docs, keys, frequent, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT rid, doc_id, i, line, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid"""
