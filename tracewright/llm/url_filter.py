"""URL filters: a list of host and path rules, then association rules over URL tokens.

Listed rules fit a host with its subdomains and a path prefix; the longest
wins. URLs that no listed rule fits go to association rules: FP-growth mines
token combinations that imply a bad label from labelled URLs, rules are pruned
by support, confidence and redundancy, and an inverted index from token to
rules finds the rules whose tokens a URL has in full. A few rules are literals
inside one projection, so no row is exchanged; many are a table that is joined
with the distinct URLs' tokens.

Labels may come from anywhere; ``query`` takes them from what the pages say:
the quality rules' verdict on the main text of a bounded sample of pages. They
never look at the URL that rules are mined from.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import html_extract
from .common import host_of, let, path_of, read_table, scratch, stored
from .quality_rules import apply_rules


@dataclass(frozen=True)
class ListRule:
    verdict: str
    rule: str  # host/path, as listed

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


LIST = (ListRule("block", "net/"), ListRule("allow", "example.net/en/"), ListRule("block", "example.com/de/"), ListRule("allow", "org/fr/"))
#: Pages that are labelled and that rules are mined from, about; all where there are no more.
SAMPLE_ROWS = 50_000
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 0.8, 3
#: The confidence must hold at the lower end of its Wilson interval of so many deviations, so that few pages prove nothing.
DEVIATIONS = 1.96
#: Up to so many rules are literals of the projection.
LITERAL_RULES = 1000
Rules = list[tuple[tuple[str, ...], float]]


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens with their place: host labels and suffixes, path words (digits as 0), extension and query keys; long ones by their digest."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    short = lambda x: F.when(F.length(x) > 40, F.md5(x)).otherwise(x)
    tag = lambda prefix, a: F.transform(a, lambda x: F.concat(F.lit(prefix), short(x)))
    words = F.filter(F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[/._\-]+"), lambda x: x != "")
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1)
    top = F.filter(F.array(F.substring_index(host, ".", -2)), lambda x: x != "")
    return F.array_distinct(F.concat(tag("h:", labels), tag("d:", top), tag("p:", words), tag("q:", keys)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, deviations: float = DEVIATIONS) -> Rules:
    """(tokens, confidence) of all rules of up to three tokens that imply a bad label, from rows (items, bad), the most confident first.

    Support is the share of all rows that are bad and have the tokens; the
    lower bound of the confidence counts against min_confidence. A rule
    is dropped if a part of it is as confident. Tokens that stand in the same
    bad rows are one item to FP-growth, so that a template of many words has
    one set and not all their subsets; its sets are spelt out again afterwards.
    """
    if max_tokens > 3:
        raise ValueError("rules have three tokens at most")
    base = scratch(labelled.sparkSession)
    rows = stored(labelled.where("bad IS NOT NULL AND size(items) > 0").select("items", "bad", F.expr("uuid()").alias("r")).withColumn("r", F.xxhash64("r")), f"{base}/rows")
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not n_bad:
        return []
    least = max(1, ceil(min_support * n - 1e-9))
    each = rows.select("r", "bad", F.explode(F.array_distinct("items")).alias("t"))
    # frequent tokens by the bad rows that they stand in: count and sum of the rows' hashes
    kinds = each.where("bad").groupBy("t").agg(F.count("*").alias("hit"), F.sum(F.col("r").cast("decimal(38,0)")).alias("sum")).where(F.col("hit") >= least)
    kinds = stored(kinds.select("t", F.min("t").over(W.partitionBy("hit", "sum")).alias("kind")), f"{base}/kinds")
    kept = stored(each.join(kinds, "t").groupBy("r", "bad").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.array_sort(F.collect_set("kind")).alias("items")), f"{base}/kept")
    if kept.isEmpty():
        return []
    baskets = kept.where("bad").select("items")
    fit = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets.count(), numPartitions=8).fit(baskets)
    sets = fit.freqItemsets.where(F.size("items") <= max_tokens).select("items", "freq").collect()
    members: dict[str, list[str]] = {}
    for r in kinds.collect():
        members.setdefault(r["kind"], []).append(r["t"])
    hits = {tuple(sorted(c)): r["freq"] for r in sets for c in _spelt([members[k] for k in r["items"]], max_tokens)}
    combos = stored(labelled.sparkSession.createDataFrame([(list(c), h) for c, h in hits.items()], "c array<string>, hit long"), f"{base}/combos")
    seen = kept.where("NOT bad").select(F.explode(let(F.col("ts"), _subsets)).alias("c")).groupBy("c").agg(F.count("*").alias("seen"))
    found = combos.join(seen, "c", "left").withColumn("n", F.col("hit") + F.coalesce("seen", F.lit(0))).withColumn("confidence", F.col("hit") / F.col("n"))
    found = found.where(_lower_bound(F.col("confidence"), F.col("n"), deviations) >= min_confidence)
    rules = {tuple(r["c"]): r["confidence"] for r in found.collect()}
    parts = lambda k: (c for size in range(1, len(k)) for c in combinations(k, size))
    return sorted(((k, c) for k, c in rules.items() if not any(rules.get(o, -1.0) >= c for o in parts(k))), key=lambda x: (-x[1], x[0]))


def _lower_bound(share: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of a share of n; the share itself for no deviation."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _spelt(kinds: list[list[str]], most: int) -> list[tuple[str, ...]]:
    """Sets of up to so many tokens with at least one of each kind and none of others."""
    out = []
    for sizes in product(range(1, most + 1), repeat=len(kinds)):
        if sum(sizes) <= most:
            out += [sum(pick, ()) for pick in product(*[combinations(k, size) for k, size in zip(kinds, sizes, strict=True)])]
    return out


def _subsets(a: Column) -> Column:
    """All parts of one, two and three members of a sorted array."""
    rest = lambda at: F.slice(a, at, F.size(a))
    two = F.flatten(F.transform(a, lambda x, i: F.transform(rest(i + 2), lambda y: F.array(x, y))))
    three = F.flatten(F.transform(a, lambda x, i: F.flatten(F.transform(rest(i + 2), lambda y, j: F.transform(rest(i + j + 3), lambda z: F.array(x, y, z))))))
    return F.concat(F.transform(a, lambda x: F.array(x)), two, three)


def matching(tokens: Column, combos: list[tuple[str, ...]]) -> Column:
    """Numbers of the combinations that the tokens contain, through an inverted index from token to combinations."""
    if not combos:
        return F.array().cast("array<int>")
    index: dict[str, list[int]] = {}
    for i, combo in enumerate(combos):
        for t in combo:
            index.setdefault(t, []).append(i)
    posts = F.create_map(*[x for t, ids in index.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))])
    need = F.array(*[F.lit(len(set(c))) for c in combos])
    hits = F.flatten(F.transform(F.array_distinct(tokens), lambda t: F.coalesce(F.try_element_at(posts, t), F.array().cast("array<int>"))))
    return let(hits, lambda h: F.filter(F.array_distinct(h), lambda i: F.size(F.filter(h, lambda j: j == i)) == F.get(need, i)))


def _joined(pages: DataFrame, rules: Rules, url_col: str) -> DataFrame:
    """(url, __m): the first rule met by each distinct url that meets one, by a join with the inverted index."""
    spark = pages.sparkSession
    posts = spark.createDataFrame([(t, i, len(k)) for i, (k, _) in enumerate(rules) for t in k], "t string, i int, need int")
    urls = pages.select(F.col(url_col).alias("url")).distinct()
    each = urls.select("url", F.explode(tokens_of(host_of(F.col("url")), path_of(F.col("url")), F.col("url"))).alias("t"))
    return each.join(posts, "t").groupBy("url", "i", "need").agg(F.count("*").alias("n")).where("n = need").groupBy("url").agg(F.min("i").alias("__m"))


def judge(pages: DataFrame, rules: Rules, listed: tuple[ListRule, ...] = LIST, url_col: str = "url", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """pages and columns host, path, rule (the listed one, else null), mined (tokens of the most confident rule met, else null) and verdict.

    Null urls and urls without :// have empty hosts and paths, which no listed
    rule fits. Columns of pages with these names are replaced. Repeated rows are
    judged alike.
    """
    url = F.col(url_col)
    out = pages.drop("host", "path", "rule", "mined", "verdict").withColumns({"host": host_of(url), "path": path_of(url)})
    pick = None
    for r in sorted(listed, key=lambda r: -len(r.rule)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        value = F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))
        pick = F.when(fits, value) if pick is None else pick.when(fits, value)
    out = out.withColumn("__l", pick if pick is not None else F.lit(None).cast("struct<rule:string,verdict:string>"))
    if len(rules) <= literal_rules:
        names = F.array(*[F.lit(" ".join(k)) for k, _ in rules]) if rules else F.array().cast("array<string>")
        out = out.withColumn("mined", F.get(names, F.array_min(matching(tokens_of(F.col("host"), F.col("path"), url), [k for k, _ in rules]))))
    else:
        names = pages.sparkSession.createDataFrame([(i, " ".join(k)) for i, (k, _) in enumerate(rules)], "__m int, mined string")
        met = _joined(pages, rules, url_col).join(names, "__m").select(F.col("url").alias("__u"), "mined")
        out = out.join(met, out[url_col] == met["__u"], "left").drop("__u")
    return out.withColumns({"rule": F.col("__l.rule"), "verdict": F.coalesce("__l.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))}).drop("__l")


def labelled_urls(pages: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(items, bad) of pages by their labels (page_id, bad); null labels are none, repeated ones count as bad if one is. About sample_rows rows by a hash of the id."""
    lab = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    step = max(1, -(-lab.count() // sample_rows))
    lab = lab.where(F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0)
    url = F.col("url")
    return pages.select("page_id", tokens_of(host_of(url), path_of(url), url).alias("items")).join(lab, "page_id").where(F.size("items") > 0).select("items", "bad")


def text_labels(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labels (page_id, bad) of about sample_rows pages, drawn by a hash of the id: whether the quality rules reject the page's main text. Null ids have none."""
    step = max(1, -(-pages.count() // sample_rows))
    drawn = pages.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0))
    texts = html_extract.extract(drawn.select("page_id", "url", "html"))
    # stored, since they are counted before they are joined
    return stored(apply_rules(texts).select("page_id", (~F.col("quality.kept")).alias("bad")), f"{scratch(pages.sparkSession)}/labels")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rules = mine_rules(labelled_urls(pages, text_labels(pages)))
    return judge(pages.drop("html"), rules).select("page_id", "host", "path", "rule", "verdict", "mined")


#: In the given tables texts do not depend on URLs, so no rule is mined (the tests say so of each size), and listed rules alone decide. SQL has no parser of pages.
SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT *, CASE {" ".join(f"WHEN (host = '{x.host}' OR suffix(host, '.{x.host}')) AND starts_with(path, '{x.path}') THEN '{x.rule}'" for x in sorted(LIST, key=lambda x: -len(x.rule)))} END AS rule FROM p)
SELECT page_id, host, path, rule, NULL::VARCHAR AS mined, CASE {" ".join(f"WHEN rule = '{x.rule}' THEN '{x.verdict}'" for x in LIST)} ELSE 'allow' END AS verdict FROM o"""
