"""Quality classifier: document evidence under hierarchical empirical-Bayes site priors.

Document evidence is naive Bayes over binned text measures; the odds of each
bin come from labelled rows, shrunk toward the bin's share among all labelled
rows. Two targets are judged apart: junk (quality 0) and toxic. For each, a
site's rate is a Beta posterior: paths shrink toward their host, hosts toward
the global rate, with strengths estimated from the spread between sites. A
labelled row counts whole, an unlabelled one by half of what the document
evidence says, so the site level is an aggregate over all rows. The site
posterior is the prior odds of its documents.

All of it is built-in functions and grouped aggregates. Texts are read twice
(labelled sample, then all) and never exchanged; only sites and bins are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, let, read_table, scratch, stored
from .quality_rules import measures

TARGETS = ("junk", "toxic")
#: Labelled rows that fit the bins and the lexicon, about; sites count every labelled row.
SAMPLE_ROWS = 20_000
LEXICON_WORDS = 300
#: Cut points of the binned measures; a null measure has no evidence.
CUTS = {
    "symbol_ratio": (0.01, 0.05, 0.1, 0.2, 0.5),
    "stop_word_ratio": (0.01, 0.02, 0.05, 0.1, 0.15),
    "repeat_word_ratio": (0.05, 0.1, 0.2, 0.5),
    "mean_word_length": (2.0, 3.0, 4.0, 7.0, 9.0, 12.0),
    "dup_line_ratio": (0.1, 0.3, 0.6),
    "bang_ratio": (0.02, 0.05, 0.2, 0.5),
    "lexicon_words": (0.5, 1.5, 2.5),
}
#: Ratios of shorter texts are noise and count as null, but for symbols, which are telling in any text.
MIN_WORDS = 50
#: Pseudo-rows with which a bin is shrunk, weight of an unlabelled row, bounds of a prior's strength.
BIN_SHRINK, SOFT, STRENGTH = 5.0, 0.5, (1.0, 1e4)


def _bins(text: Column, lexicon: list[str]) -> Column:
    """(n_words, bins): the bin of each measure in the order of CUTS."""
    t = F.coalesce(text, F.lit(""))
    m = F.col("__m")
    n = m["w"]["n_words"]
    per = lambda a, b, least=MIN_WORDS: F.when((b > 0) & (n >= least), a / b)
    value = {
        "symbol_ratio": per(m["n_symbols"], n, 1),
        "stop_word_ratio": per(m["w"]["n_stop"], n),
        "repeat_word_ratio": per(m["w"]["n_repeat"], n),
        "mean_word_length": per(m["w"]["word_chars"], n),
        "dup_line_ratio": per(m["l"]["dup"], m["l"]["n"]),
        "bang_ratio": per(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), n, 1),
        "lexicon_words": F.size(F.array_distinct(F.filter(alnum_words(text), lambda w: w.isin(lexicon)))) if lexicon else F.lit(0),
    }
    # bound first: a value that cuts compare again and again would be computed as often
    cut = lambda k: lambda v: F.when(v.isNotNull(), sum(((v > c).cast("int") for c in CUTS[k]), F.lit(0)))
    return F.array(*[let(v, cut(k)) for k, v in value.items()])


def _lexicon(labelled: DataFrame, words: int) -> list[str]:
    """Words that mark toxic rows: in a fiftieth of them at least, ten times as frequent as elsewhere and by six standard errors."""
    w = labelled.select("toxic", F.explode(F.array_distinct(alnum_words(F.col("text")))).alias("w"))
    counts = w.groupBy("w").agg(F.sum(F.col("toxic").cast("double")).alias("a"), F.sum(1.0 - F.col("toxic")).alias("b"))
    n = labelled.agg(F.sum(F.col("toxic").cast("double")).alias("a"), F.sum(1.0 - F.col("toxic")).alias("b")).first()
    if not n["a"] or not n["b"]:
        return []
    rate = (F.col("a") + F.col("b")) / (n["a"] + n["b"])
    pa, pb, both = F.col("a") / n["a"], F.col("b") / n["b"], (F.col("a") + F.col("b")) / (n["a"] + n["b"])
    z = (pa - pb) / F.sqrt(both * (1 - both) * (1 / n["a"] + 1 / n["b"]))
    top = counts.where(F.col("a") >= max(5.0, 0.02 * n["a"])).select("w", z.alias("z"), (pa > 10 * pb).alias("marks")).where("marks AND z > 6").orderBy(F.desc("z"), "w").limit(words)
    return [r["w"] for r in top.collect()]


def _strength(mean: float, spread: float, groups: float, total: float) -> float:
    """Beta strength by moments: the spread of the rates beyond what sampling gives."""
    if not total or mean <= 0 or mean >= 1:
        return STRENGTH[1]
    tau = spread - mean * (1 - mean) * groups / total
    return STRENGTH[1] if tau <= 0 else min(STRENGTH[1], max(STRENGTH[0], mean * (1 - mean) / tau - 1))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS, keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """docs (with its text unless keep_text is False) and columns host_junk, host_toxic, path_junk, path_toxic, p_junk, p_toxic and kept.

    kept is false where either probability exceeds the threshold and for texts
    without a word (null, empty, blank). Null hosts and paths are sites of their
    own. Labels with a null id or value are ignored, repeated ones count by
    their worst value. Without labels nothing is known and all texts with words
    stay. Repeated rows are judged alike. Columns of docs with these names are replaced.
    """
    base = scratch(docs.sparkSession)
    docs = docs.drop("host_junk", "host_toxic", "path_junk", "path_toxic", "p_junk", "p_toxic", "kept")
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    lab = lab.groupBy(F.col("doc_id").alias("__id")).agg((1 - F.min("quality")).cast("int").alias("junk"), F.max("toxic").cast("int").alias("toxic"))
    lab = stored(lab, f"{base}/labels")
    step = max(1, -(-lab.count() // sample_rows))
    sample = lab.where(F.pmod(F.xxhash64("__id"), F.lit(step)) == 0)  # about sample_rows slim rows: bounded, so it is broadcast
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    lexicon = _lexicon(source.join(F.broadcast(sample), "__id"), LEXICON_WORDS)

    rest = [c for c in docs.columns if keep_text or c != text_col]
    host, path = (F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in (host_col, path_col))
    held = docs.withColumn("__m", measures(F.col(text_col))).select(*rest, F.col(id_col).alias("__id"), host.alias("__host"), path.alias("__path"), F.col("__m")["w"]["n_words"].alias("__n"), _bins(F.col(text_col), lexicon).alias("__bins"))
    held = stored(held, f"{base}/evidence")

    rows = held.select("__id", F.posexplode("__bins").alias("f", "bin")).where("bin IS NOT NULL").join(F.broadcast(sample), "__id")
    counts = rows.groupBy("f", "bin").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).collect()
    evidence = {t: _evidence(counts, t) for t in TARGETS}
    n_all, *n_bad = lab.agg(F.count("*"), *[F.sum(t) for t in TARGETS]).first()
    prior = {t: ((b or 0) + 0.5) / (n_all + 1) if n_all else 0.01 for t, b in zip(TARGETS, n_bad, strict=True)}

    def llr(t: str) -> Column:
        return sum((F.coalesce(F.get(F.array(*[F.lit(x) for x in table]), F.get("__bins", F.lit(i))), F.lit(0.0)) for i, table in enumerate(evidence[t])), F.lit(0.0))

    held = held.withColumns({f"__e_{t}": llr(t) for t in TARGETS})
    slim = held.select("__id", "__host", "__path", *[f"__e_{t}" for t in TARGETS]).join(lab, "__id", "left")
    known = F.col("junk").isNotNull()
    soft = {t: 1 / (1 + F.exp(-(F.lit(math.log(prior[t] / (1 - prior[t]))) + F.col(f"__e_{t}")))) for t in TARGETS}
    weight = F.when(known, F.lit(1.0)).otherwise(F.lit(SOFT))
    paths = slim.groupBy("__host", "__path").agg(F.sum(weight).alias("n"), *[F.sum(weight * F.when(known, F.col(t).cast("double")).otherwise(soft[t])).alias(t) for t in TARGETS])
    paths = stored(paths, f"{base}/paths")
    sites = _posteriors(paths)
    sites = stored(sites, f"{base}/sites")

    out = held.join(sites, ["__host", "__path"], "left")
    p = {t: 1 / (1 + F.exp(-(_logit(F.col(f"path_{t}")) + F.col(f"__e_{t}")))) for t in TARGETS}
    bad = (p["junk"] > threshold) | (p["toxic"] > threshold)
    return out.select(*rest, "host_junk", "host_toxic", "path_junk", "path_toxic", *[p[t].alias(f"p_{t}") for t in TARGETS], ((F.col("__n") > 0) & ~bad).alias("kept"))


def _evidence(counts: list, target: str) -> list[list[float]]:
    """Log-likelihood ratios by measure and bin."""
    out = []
    for f, cuts in enumerate(CUTS.values()):
        mine = {r["bin"]: (r["n"], r[target]) for r in counts if r["f"] == f}
        total, bad = sum(n for n, _ in mine.values()), sum(b for _, b in mine.values())
        row = []
        for k in range(len(cuts) + 1):
            n, b = mine.get(k, (0, 0))
            share = (n + 0.5) / (total + 0.5 * (len(cuts) + 1)) if total else 1.0
            row.append(math.log((b + BIN_SHRINK * share) / (bad + BIN_SHRINK)) - math.log((n - b + BIN_SHRINK * share) / (total - bad + BIN_SHRINK)) if bad and total > bad else 0.0)
        out.append(row)
    return out


def _posteriors(paths: DataFrame) -> DataFrame:
    """Posterior rates of hosts and paths from their counts n and, by target, of bad rows."""
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS])
    total = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("g"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    mean = {t: min(1 - 1e-6, max(1e-6, total[t] / total["n"])) if total["n"] else 0.01 for t in TARGETS}
    spread = hosts.agg(*[(F.sum(F.col("n") * (F.col(t) / F.col("n") - mean[t]) ** 2) / F.sum("n")).alias(t) for t in TARGETS]).first()
    m = {t: _strength(mean[t], spread[t] or 0.0, total["g"], total["n"] or 0.0) for t in TARGETS}
    hosts = hosts.select("__host", *[((F.col(t) + m[t] * mean[t]) / (F.col("n") + m[t])).alias(f"host_{t}") for t in TARGETS])
    both = paths.join(hosts, "__host")
    s = both.agg(F.count("*").alias("g"), F.sum("n").alias("n"), *[(F.sum(F.col("n") * (F.col(t) / F.col("n") - F.col(f"host_{t}")) ** 2) / F.sum("n")).alias(t) for t in TARGETS]).first()
    k = {t: _strength(mean[t], s[t] or 0.0, s["g"], s["n"] or 0.0) for t in TARGETS}
    return both.select("__host", "__path", *[f"host_{t}" for t in TARGETS], *[((F.col(t) + k[t] * F.col(f"host_{t}")) / (F.col("n") + k[t])).alias(f"path_{t}") for t in TARGETS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, read_table(spark, sf_dir, "labels"), keep_text=False)
