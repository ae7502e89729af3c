"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each text becomes its set of hashed k-word shingles, a digest of that set
   and a signature of M min-hashes (one pass of Arrow batches). Documents of
   equal sets share one representative from there on.
2. Representatives are posted under each (coordinate, value). Posts that stand
   alone are dropped: a document that keeps fewer than T posts has no partner.
3. Prefix filter: two signatures that agree in T of M coordinates agree in one
   of the M - T + 1 rarest of either. Only those posts are joined.
4. Post lists are never expanded into all pairs. In each round a list names
   the most central member outside its earlier leaders' components; its
   members are checked against it, and links merge components. A component
   needs links, not all pairs, so lists of one component are done.
5. What is left are lists around a leader L with members not linked to it. Let
   D(x) be the symmetric difference of the sets x and L, and q = (1-t)/(1+t) for
   the similarity t. x and y are linked if |D(x) ^ D(y)| <= q(|x|+|y|). Where x
   is not linked to L this needs |D(x) & D(y)| > (1-q)/2 |D(y)|, as follows from
   |D(x)| > q(|x|+|L|) and |y| <= |L|+|D(y)|. So such pairs are found exactly by
   a prefix join over the rare members of D, with a bound by position: edited
   copies that share nothing but L meet nobody, however many they are.
6. Candidates of leaders must agree in T coordinates; all survivors are
   confirmed by the Jaccard similarity of their full shingle sets.

With M = 64 and T = 36, a pair at similarity 0.8 fails the signature steps with
probability 3e-6 (binomial tail); more similar pairs with far less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, scratch, stored

COORDINATES, MATCHES = 64, 36
#: Rounds of one leader a list before the remaining members are joined by their differences.
LEADER_ROUNDS = 2
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word runs; a shorter text is one shingle, one without words none.

    bytes.lower and bytes.split know ASCII only, so A-Z are lower-cased and words end at U+0020 and U+0009 to U+000D.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(h) if len(h) < k else k, dtype=np.uint64)
        for j in range(min(k, len(h))):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, m, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, m, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The high halves of the least a*x + b (mod 2^64) of each coordinate, in blocks of bounded size."""
    best = np.full(len(a), _MASK, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            x = _mix(shingles[at : at + 4096])
            best = np.minimum(best, (a[:, None] * x[None, :] + b[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signer(k: int, m: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(m)
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            yield pd.DataFrame({
                "id": pdf["id"],
                "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sig": [signature(s, a, b) if len(s) else None for s in sets],
            })

    return sign


def _verifier(k: int, percent: int):
    """Keeps the pairs whose full sets are similar enough; a text met again in the next row is parsed once."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for pdf in batches:
            keep = []
            for x, tx, y, ty in zip(pdf["x"], pdf["tx"], pdf["y"], pdf["ty"], strict=True):
                if x != last:
                    last, mine = x, shingle_set(tx, k)
                other = shingle_set(ty, k)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pdf.loc[keep, ["x", "y"]]

    return verify


def _differ(k: int, percent: int):
    """(l, y, n, linked, delta): the symmetric difference of y's set and its leader's."""

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for l, tl, y, ty in zip(pdf["x"], pdf["tx"], pdf["y"], pdf["ty"], strict=True):
                lead, mine = shingle_set(tl, k), shingle_set(ty, k)
                delta = np.setxor1d(lead, mine, assume_unique=True)
                both = (len(lead) + len(mine) - len(delta)) // 2
                out.append((l, y, len(mine), 100 * both >= percent * (both + len(delta)), delta.view(np.int64)))
            yield pd.DataFrame(out, columns=["l", "y", "n", "linked", "delta"])

    return differ


def components(links: DataFrame, base: str) -> DataFrame:
    """(id, component): the least id reachable over links (x, y), by alternating large and small stars.

    Every step is an aggregation and a window over slim rows, stored in the
    shared folder; only the number of links that moved comes to the driver.
    """
    edges = stored(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), f"{base}/e0")
    step = 0
    while True:
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u move to the least of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small, f"{base}/e{step}")
        old_n, new_n = edges.count(), new.count()
        same = old_n == new_n and not new.join(edges, ["u", "v"], "left_anti").take(1)
        edges = new
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles (size of its set) and component_id, the least id reachable over links, its own included.

    Linked are sets with 100 * intersection >= percent * union. Texts without
    words (null, empty, blank) have empty sets and stand alone. Rows that repeat
    an id each keep their count; the id is linked where one of its texts is.
    Null ids keep a null component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = scratch(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInPandas(_signer(k, coordinates), "id long, n long, digest binary, sig array<int>"), f"{base}/signed")
    usable = signed.where("digest IS NOT NULL AND id IS NOT NULL")

    # equal sets: one representative each, the least id
    reps = stored(usable.groupBy("digest").agg(F.min_by(F.struct("id", "sig"), "id").alias("r")).select("digest", "r.id", "r.sig"), f"{base}/reps")
    posts = reps.select("id", F.posexplode("sig").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    mine = W.partitionBy("id")
    prefix = (
        posts.join(shared, "key")
        .withColumns({"n": F.count("*").over(mine), "weight": F.sum("df").over(mine), "r": F.row_number().over(mine.orderBy("df", "key"))})
        # matches - 1 posts are outside the prefix; the ones that stood alone were the rarest
        .where(F.col("r") <= F.col("n") - (matches - 1))
        .select("key", "id", "weight")
    )
    prefix = stored(prefix, f"{base}/prefix")

    # texts of documents with a post, once: all later joins read these
    held = texts.join(prefix.select("id").distinct(), "id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h")
    held = stored(held, f"{base}/held")
    lists = prefix.withColumn("comp", F.col("id"))
    links = label = first = None
    led = prefix.select("key", F.col("id").alias("comp")).limit(0)  # components of the leaders a list has had
    for r in range(rounds):
        # an original shares more of its posts, with more documents, than its edited copies do
        free = lists.join(led, ["key", "comp"], "left_anti")
        leader = free.groupBy("key").agg(F.max_by(F.struct("id", "comp"), F.struct("weight", "id")).alias("l")).select("key", F.col("l.id").alias("x"), F.col("l.comp").alias("cx"))
        leader = stored(leader, f"{base}/leader{r}")
        first = leader if r == 0 else first
        pairs = lists.join(leader, "key").where("comp <> cx").select(F.col("x").alias("p"), F.col("id").alias("q")).distinct()
        cand = stored(_agreeing(pairs, reps, matches), f"{base}/cand{r}")
        found = stored(_confirm(cand, held, k, percent), f"{base}/links{r}")
        links = found if links is None else links.union(found)
        label = stored(components(links, f"{base}/cc{r}"), f"{base}/label{r}")
        lists = stored(_torn(prefix, label), f"{base}/lists{r}")
        led = leader.select("key", F.col("x").alias("id")) if r == 0 else led.select("key", "id").union(leader.select("key", F.col("x").alias("id")))
        led = led.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        if lists.isEmpty():
            break
    else:
        around = lists.join(first.select("key", F.col("x").alias("l")), "key").where("id <> l").select(F.col("l").alias("p"), F.col("id").alias("q")).distinct()
        delta = stored(_with_texts(around, held).mapInPandas(_differ(k, percent), "l long, y long, n long, linked boolean, delta array<long>"), f"{base}/delta")
        cand = stored(_by_difference(delta, label, percent), f"{base}/cand")
        # the exact comparisons with leaders count too, where signatures had differed by chance
        links = links.union(stored(_confirm(cand, held, k, percent), f"{base}/links")).union(delta.where("linked").select(F.col("l").alias("x"), "y"))
        label = stored(components(links, f"{base}/cc"), f"{base}/label")

    rep = reps.select("digest", F.col("id").alias("rep"))
    out = signed.join(rep, "digest", "left")
    out = out.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def _torn(prefix: DataFrame, label: DataFrame) -> DataFrame:
    """Posts of the lists whose members are of more than one component."""
    posts = prefix.join(label, "id", "left").select("key", "id", "weight", F.coalesce("component", "id").alias("comp"))
    torn = posts.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    return posts.join(torn, "key", "left_semi")


def _agreeing(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """Pairs whose whole signatures collide in enough coordinates."""
    sig = reps.select("id", "sig")
    met = pairs.join(sig.select(F.col("id").alias("p"), F.col("sig").alias("sp")), "p").join(sig.select(F.col("id").alias("q"), F.col("sig").alias("sq")), "q")
    agree = F.aggregate(F.zip_with("sp", "sq", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    return met.where(agree >= matches).select("p", "q").distinct()


def _by_difference(delta: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, q) of different components of which one is not linked to the leader, by a prefix join over their differences."""
    t = percent / 100
    q = (1 - t) / (1 + t)
    d = delta.join(label.select(F.col("id").alias("y"), "component"), "y", "left").withColumns({"comp": F.coalesce("component", "y"), "size": F.size("delta")})
    each = d.select("l", "y", "n", "linked", "comp", "size", F.explode("delta").alias("e"))
    shared = each.groupBy("l", "e").agg(F.count("*").alias("c"), F.count_if(~F.col("linked")).alias("f")).where("c > 1 AND f > 0").select("l", "e", "c")
    mine = W.partitionBy("l", "y")
    posts = (
        each.join(shared, ["l", "e"])
        .withColumns({"k": F.count("*").over(mine), "r": F.row_number().over(mine.orderBy("c", "e"))})
        # members of D that no pair can share come first in the order
        .withColumn("i", F.col("size") - F.col("k") + F.col("r") - 1)
        .select("l", "e", "y", "n", "linked", "comp", "size", "i")
    )
    near = F.floor(F.lit((1 - q) / 2 - 1e-9) * F.col("size"))  # an overlap exceeds this
    far = F.ceil(F.col("size") - F.lit(q * (1 + 1 / t) + 1e-9) * F.col("n"))
    short = posts.where(F.col("i") < F.col("size") - near)
    long = posts.where(~F.col("linked") & (F.col("i") < F.col("size") - F.greatest(far, F.lit(1)) + 1))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("l", "e", *[F.col(c).alias(f"{c}2") for c in ("y", "n", "comp", "size", "i")])
        room = F.least(F.col("size") - F.col("i"), F.col("size2") - F.col("i2"))
        need = (F.col("size") + F.col("size2") - F.lit(q + 1e-9) * (F.col("n") + F.col("n2"))) / 2
        on = (F.col("comp") != F.col("comp2")) & (room >= need)
        return a.join(b, ["l", "e"]).where(on).select(F.least("y", "y2").alias("p"), F.greatest("y", "y2").alias("q"))

    apart = short.where("NOT linked")
    return met(apart.alias("a"), apart.alias("b")).union(met(long, short.where("linked"))).distinct()


def _with_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(x, tx, y, ty) of pairs (p, q)."""
    both = pairs.join(held.select(F.col("id").alias("p"), F.col("text").alias("tp")), "p").join(held.select(F.col("id").alias("q"), F.col("text").alias("tq")), "q")
    return both.select(F.col("p").alias("x"), F.col("tp").alias("tx"), F.col("q").alias("y"), F.col("tq").alias("ty"))


def _confirm(cand: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (x, y) among candidates (p, q), by their full sets."""
    return _with_texts(cand, held).mapInPandas(_verifier(k, percent), "x long, y long").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: All pairs that share a shingle, then the least id reachable; for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id"""
