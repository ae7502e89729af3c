"""Quality rules: a table of thresholds compiled into one projection, with built-in functions only.

Every metric is computed inside its row; the plan is a scan and a projection
without an exchange, so it scales with the number of input splits alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, let, read_table, white_words

SYMBOLS = "#*$%&|<>"
#: Marks that a stop word may touch.
MARKS = ".,;:!?\"'()[]"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is it that was for on are as with they at be this have from or by not but what all were when we there an your which their if will each about how "
    "le la les de des du un une et est en que qui dans pour pas sur avec ce il au par plus ne se sont "
    "der die das und ist von den mit zu ein eine nicht auf für im dem des sich auch es an werden als "
    "el los las y es un una por con para del se no lo su al como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` must hold; a None bound is open. A null metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", "dup_line_ratio", None, 0.60),
    Rule("repeat_word_ratio", "repeat_word_ratio", None, 0.50),
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def repeated_window_words(words: Column, k: int = 3) -> Column:
    """Number of words that stand in a k-word window found twice or more.

    Windows are compared by 64-bit hash. Texts without a repeated hash stop
    there; others sort (hash, position), take the positions whose hash has an
    equal neighbour, and measure the union of their k-word spans.
    """

    def spans(pos: Column) -> Column:
        step = F.transform(pos, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(pos, j + 1) - p, F.lit(k))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        flags = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(flags, lambda p: p.isNotNull()))

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(let(ordered, repeated), spans)).otherwise(F.lit(0))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, let(grams, count)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of the counts of one text; null counts as empty. Stop words count in any case and beside marks."""
    t = F.coalesce(text, F.lit(""))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    with_word = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    parts = lambda w: F.struct(
        F.size(w).alias("n_words"),
        F.length(F.array_join(w, "")).alias("word_chars"),
        F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(MARKS))).isin(*STOP_WORDS))).alias("n_stop"),
        repeated_window_words(w).alias("n_repeat"),
    )
    return F.struct(let(white_words(t), parts).alias("w"), F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).alias("n_symbols"), let(with_word, lines).alias("l"))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with one struct column ``quality``: counts, ratios, the failed rules and the verdicts.

    Null, empty and blank texts have zero words and fail the base rule. Ratios
    with a zero denominator are null and pass. Repeated rows are judged alike;
    an existing column ``quality`` is replaced, others are untouched.
    """
    m = F.col("__m")
    long = lambda c: c.cast("long")
    n, rep = long(m["w"]["n_words"]), long(m["w"]["n_repeat"])
    ratios = {
        "mean_word_length": _ratio(m["w"]["word_chars"], n),
        "symbol_ratio": _ratio(m["n_symbols"], n),
        "stop_word_ratio": _ratio(m["w"]["n_stop"], n),
        "dup_line_ratio": _ratio(m["l"]["dup"], m["l"]["n"]),
        "repeat_word_ratio": _ratio(rep, n),
    }
    base_failed = (n < min_words) | (100 * rep > max_repeat_percent * n)

    def broken(rule: Rule) -> Column:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (ratios[rule.metric] < rule.low)
        if rule.high is not None:
            bad = bad | (ratios[rule.metric] > rule.high)
        return F.coalesce(bad, F.lit(False))

    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    passes = ~reduce(lambda a, b: a | b, [broken(r) for r in rules], F.lit(False))
    out = F.struct(
        n.alias("n_words"), long(m["w"]["word_chars"]).alias("word_chars"), long(m["n_symbols"]).alias("n_symbols"),
        long(m["l"]["dup"]).alias("n_dup_lines"), rep.alias("n_repeat_words"), *[c.alias(k) for k, c in ratios.items()],
        failed.alias("failed_rules"), base_failed.alias("base_failed"), (~base_failed & passes).alias("kept"),
    )
    return docs.withColumn("__m", measures(F.col(text_col))).withColumn("quality", out).drop("__m")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", *[F.col("quality")[c].alias(c) for c in COLUMNS])


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    r = {x.name: x for x in RULES}
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM p),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(trim(x, '{MARKS.replace("'", "''")}')) IN ({stop}))) AS n_stop, len(l) AS n_lines
  FROM d LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN {r['mean_word_length'].low} AND {r['mean_word_length'].high}
  AND n_symbols / n_words::DOUBLE <= {r['symbol_ratio'].high} AND n_stop / n_words::DOUBLE >= {r['stop_word_ratio'].low}
  AND n_dup_lines / n_lines::DOUBLE <= {r['dup_line_ratio'].high} AND n_repeat_words / n_words::DOUBLE <= {r['repeat_word_ratio'].high} AS kept
FROM b"""


SQL = _sql()
