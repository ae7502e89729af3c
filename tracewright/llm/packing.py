"""Variable-capacity best-fit packing of token counts into sequences.

Texts longer than the largest permitted length are cut into pieces. Pieces are
dealt into groups of bounded size, and each group is packed on its own, over
all permitted sizes at once. A sequence costs a constant, its length, and its
length squared for attention: small sequences cost less per token, large ones
waste less on a last gap. Pieces in falling order go to the open bin with the
least room that holds them. Where none does, every size that holds the piece is
filled in thought with the largest remaining pieces that fit; the size with
the least cost per token so held is opened. The cheapest plan over all menus
of permitted sizes counts. At the end each bin is cut down to
the least permitted size that holds its contents. What a group wastes is its
last open bins, whatever the input's size. Only ids and counts travel.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, scratch, stored, white_words

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence: a constant, in tokens, and the length at which attention costs as much as all else.
BIN_COST, ATTENTION = 8.0, 6144.0
GROUP_PIECES = 20_000


def cost(size: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    """Cost of one sequence of so many tokens, padding included."""
    return bin_cost + size + size * size / attention


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and (capacity, fill) of each bin; lengths are 1 to the largest capacity.

    The rule sees one bin ahead, so now and then it fares better with a size
    less: it runs with every menu of sizes, and the cheapest plan counts.
    """
    sizes = sorted(capacities)
    price = {s: cost(s, bin_cost, attention) for s in sizes}
    longest = int(lengths.max()) if len(lengths) else 0
    best = None
    for menu in (m for n in range(len(sizes), 0, -1) for m in combinations(sizes, n) if m[-1] >= longest):
        bins, offsets, fills = _fit(lengths, menu, price)
        caps = [sizes[bisect_left(sizes, f)] for f in fills]
        total = sum(price[c] for c in caps)
        if best is None or total < best[0]:
            best = total, bins, offsets, np.array(caps, dtype=np.int64), np.array(fills, dtype=np.int64)
    return best[1:]


def _fit(lengths: np.ndarray, sizes: tuple[int, ...], price: dict[int, float]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit over these sizes: bin and offset of each piece, and the fill of each bin."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    kinds, counts = (x.tolist() for x in np.unique(lengths, return_counts=True))  # remaining pieces by length, rising
    fills: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, rising
    open_at: dict[int, list[int]] = {}

    def held(n: int, size: int) -> int:
        """Tokens of a bin of this size opened for a piece of n, filled with the largest remaining pieces that fit."""
        room, at = size - n, len(kinds)
        while room and (at := bisect_right(kinds, room, 0, at)):
            at -= 1
            room -= min(counts[at], room // kinds[at]) * kinds[at]
        return size - room

    def opened(n: int) -> int:
        best = None
        for s in sizes:
            if s >= n:
                tokens = held(n, s)
                final = sizes[bisect_left(sizes, tokens)]
                if best is None or price[final] / tokens < best[0]:
                    best = price[final] / tokens, s
        return best[1]

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        counts[-1] -= 1
        if not counts[-1]:
            kinds.pop()
            counts.pop()
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
        else:
            room = opened(n)
            b = len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            if room - n not in open_at:
                insort(rooms, room - n)
                open_at[room - n] = []
            open_at[room - n].append(b)
    return bins, offsets, fills


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, attention: float = ATTENTION, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity, bin_fill.

    tokens is the count of a row's tokens, by default its words. Rows without
    tokens (null, empty, blank) keep one row of zero tokens with a null bin.
    Repeated and equally long rows are packed each; null ids are kept. An empty
    table gives no rows. Groups are drawn with a fixed seed and stored before
    use, so a repeated task sees the same ones.
    """
    top = max(capacities)
    n = tokens if tokens is not None else F.size(white_words(F.col(text_col)))
    cut = let(F.coalesce(n, F.lit(0)).cast("long"), lambda x: F.struct(x.alias("n"), F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(x - 1, F.lit(0)) / top)).alias("p")))
    pieces = docs.select(F.col(id_col).alias("id"), cut.alias("c")).select("id", F.col("c.n").alias("n"), F.explode("c.p").alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("n_tokens"), F.rand(11).alias("draw"))
    pieces = stored(pieces, f"{scratch(docs.sparkSession)}/pieces")
    full = pieces.where("n_tokens > 0")
    groups = max(1, -(-full.count() // group_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], kind="stable")
        bins, offsets, caps, fills = pack(pdf["n_tokens"].to_numpy(), capacities, bin_cost, attention)
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": pdf["n_tokens"], "bin_id": pdf["g"].to_numpy() * (1 << 32) + bins, "bin_offset": offsets, "bin_capacity": caps[bins], "bin_fill": fills[bins]})

    schema = "id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_capacity long, bin_fill long"
    packed = full.select("id", "piece", "start", "n_tokens", F.floor(F.col("draw") * groups).alias("g")).groupBy("g").applyInPandas(run, schema)
    empty = pieces.where("n_tokens = 0").select("id", "piece", "start", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_capacity", "bin_fill")])
    return packed.unionByName(empty).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
