"""HTML extraction: a suffix array over each host's pages, and structural zones.

Pages are parsed into text blocks with a zone: ``article`` or ``main`` (inside
such an element), ``drop`` (menus, headers, footers, sidebars, notices, adverts,
forms, comments; ``off`` where only a class name says so) or ``open``.

All blocks but the dropped ones, of every page, are concatenated by host as
token streams, and a suffix array with the lengths of common prefixes finds the
runs of ``run`` tokens or more that the host's distinct pages repeat. Pages with
an article or main element and pages without are two templates, counted apart.
A run belongs to the frame if half of all the host's distinct pages of the
template have it, two at least; a block is frame if such runs cover most of its
words. Then each page's text is what its host's array leaves it:

* A page with an article (else main) element that has a block of its own gives
  that element whole: markup, where it speaks, says exactly where the text ends.
* Where the array finds all blocks of that element on half of the pages, it is a
  teaser or a notice, and the text is what lies outside of it, if the page has
  more words of its own there than the element has in all.
* Other pages, and these, give their open blocks less the frame at both ends. A
  passage that pages share stays where it has words of the page's own on both
  sides, however many pages have it and however large the host is.

A host's pages are dealt into chunks of bounded bytes, copies included, and the
texts stay in the files that they are dealt to. A run that half of a host's
pages have is on half of the pages of some chunk, so the chunks' arrays find
all candidates, which every chunk then counts; of equal pages one counts. So the
result does not depend on how pages are dealt. Pages that are mostly frame are
likely near copies: they prove no frame, but lose one that the others prove; a
page that is nothing else keeps its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import host_of, read_table, scratch, stored

#: Bytes of html in a chunk, about; repeated runs have at least RUN tokens.
CHUNK_BYTES, RUN = 4_000_000, 8
#: Bytes of html in a bucket of chunks, about, beyond the session's number of shuffle partitions, and the most buckets.
BUCKET_BYTES, BUCKETS = 256_000_000, 1024
#: A run is frame on this share and number of the host's distinct pages of a template.
FRAME_SHARE, FRAME_PAGES = 0.5, 2
#: A block is frame if runs of the frame cover this share of its words.
EDGE_SHARE = 0.8
#: A page with a larger share of frame may be a near copy of others: it proves none.
COPY_SHARE = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z|(?=<))|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
DROP = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "fieldset"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose end matters for zones; the rest neither opens nor closes one.
NESTED = DROP | {"article", "main", "header", "div", "section", "ul", "ol", "table", "body", "html", "span", "p", "li", "dl"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "param", "track"}
DROP_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Inside an article one of these may follow such a word, and nothing else.
NAME_ENDS = {"area", "articles", "bar", "block", "box", "buttons", "container", "form", "item", "items", "links", "list", "news", "posts", "section", "stories", "wrap", "wrapper"}
#: No part of an article is called by these, whatever else its name says.
NEVER_TEXT = {"ad", "ads", "advert", "adverts", "advertisement", "consent", "cookie", "cookies", "gdpr", "newsletter", "popup", "promo", "promoted", "signup", "sponsor", "sponsored", "subscribe"}
#: An article so called shows another one or belongs to it.
OTHER_ARTICLES = {"comment", "comments", "teaser", "teasers"}
#: A name that starts so says what the page around has, not what the element is.
NAME_STARTS = {"has", "is", "no", "with", "without"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}


def _named_off(tag: str, a: dict[str, str], inside: bool) -> bool:
    """Whether a class name or id says that the element is no part of the text; article and main are, whatever they are called, but for reader comments."""
    if tag in ("main", "body", "html"):
        return False
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{a.get('class', '')} {a.get('id', '')}").lower().split()
    if tag == "article":
        return bool(OTHER_ARTICLES & set(names))
    for name in names:
        first, *rest = [p for p in re.split(r"[^a-z0-9]+", name) if p] or [""]
        if inside:
            if first in DROP_NAMES and set(rest) <= NAME_ENDS or first not in NAME_STARTS and {first, *rest} & NEVER_TEXT:
                return True
        elif first not in NAME_STARTS and ({first, *rest} & DROP_NAMES or "header" in (first, *rest)):
            return True
    return False


def _zone(tag: str, attrs: str, inside: bool) -> str | None:
    """The zone an element opens, or None; inside says that it lies in article or main."""
    if tag in DROP or (tag == "header" and not inside):
        return "drop"
    if attrs.strip():
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        role = a.get("role", "").lower()
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) or role in DROP_ROLES:
            return "drop"
        if _named_off(tag, a, inside):
            return "off"
        if role in ("main", "article"):
            return "main"
    return tag if tag in ("article", "main") else None


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks in page order: character references decoded, white space single, no empty blocks.

    Zones are drop, off, article, main and open; a main element inside off is main. Unclosed elements end with the page;
    an end tag closes what is open inside its element; a tag cut off by the
    page's end is markup, not text. Only block elements begin and end a block:
    the text around an inline element is one, also where that is dropped.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, list[str] | None]] = []  # (tag, zone it lies in, what its block had before it if it is inline and dropped)
    places: dict[str, list[int]] = {}  # of each tag in the stack, so that an end tag needs no search
    zone, parts, at, n = "open", [], 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((zone, text))
            parts.clear()

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                parts.append(html.unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag in NESTED and places.get(tag):
                for closed, outer, held in reversed(stack[places[tag][-1] :]):
                    if closed in BLOCK or zone != outer:
                        flush()
                    zone = outer
                    if held is not None:
                        parts[:0] = held
                    places[closed].pop()
                    stack.pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID or tag not in NESTED or m[3].rstrip().endswith("/"):
            continue
        opened = _zone(tag, m[3], zone in ("article", "main"))
        inner = zone
        if opened and (zone not in ("drop", "off") or (zone == "off" and opened == "main")) and not (zone == "article" and opened == "main"):
            inner = opened
        held = None
        if inner != zone:
            if tag not in BLOCK and inner in ("drop", "off"):
                held = parts[:]
                parts.clear()
            else:
                flush()
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, zone, held))
        zone = inner
    flush()
    # of inline elements that the page leaves open
    for _, zone, held in reversed(stack):
        if held:
            parts[:0] = held
            flush()
    return out


def main_blocks(blocks: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """(kind, texts): the article's blocks, else main's, else all that are not dropped."""
    for kind in ("article", "main"):
        found = [t for z, t in blocks if z == kind or (kind == "main" and z == "article")]
        if found:
            return "main", found
    return "open", [t for z, t in blocks if z == "open"]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes in order, and the length of the prefix that each shares with the one before it.

    Ranks are doubled in depth until all differ, of those suffixes alone that
    still equal another; the ranks of all depths then give the common lengths,
    from the deepest down.
    """
    n = len(tokens)
    order, common = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return order, common
    left, levels, step = np.argsort(tokens, kind="stable"), [], 1
    rank, outer, inner = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), tokens[left]
    while True:
        at = np.arange(len(left))
        group = np.r_[True, outer[1:] != outer[:-1]]
        part = group | np.r_[True, inner[1:] != inner[:-1]]
        rank[left] = outer + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank.copy())
        left = left[~(part & np.r_[part[1:], True])]
        if not len(left):
            break
        outer = rank[left]
        inner = np.where(left + step < n, rank[np.minimum(left + step, n - 1)] + 1, 0)
        by = np.argsort(outer * (n + 1) + inner)
        left, outer, inner = left[by], outer[by], inner[by]
        step *= 2
    order[rank] = np.arange(n)
    before, here = order[:-1], order[1:]
    off = common[1:]
    for depth in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(before, here) + off < n)
        equal = levels[depth][before[inside] + off[inside]] == levels[depth][here[inside] + off[inside]]
        off[inside[equal]] += 1 << depth
    return order, common


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each position the number of distinct pages with its run of tokens, 0 where the page ends before the run does."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # an end mark of its own after each page, so that no common prefix crosses it
    ends = np.flatnonzero(np.r_[page[1:] != page[:-1], True])
    marked = np.insert(tokens.astype(np.int64), ends + 1, -1 - np.arange(len(ends)))
    owner = np.insert(page.astype(np.int64), ends + 1, page[ends])
    order, common = suffix_array(marked)
    group = np.cumsum(common < run) - 1
    seen = np.unique(group * (int(page.max()) + 1) + owner[order])
    pages = np.bincount(seen // (int(page.max()) + 1))
    out = np.zeros(len(marked), dtype=np.int64)
    out[order] = pages[group]
    out = np.delete(out, ends + np.arange(1, len(ends) + 1))
    whole = np.zeros(n, dtype=bool)
    if n >= run:
        whole[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    return np.where(whole, out, 0)


def word_hashes(words: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def run_hashes(h: np.ndarray, run: int) -> np.ndarray:
    """A hash of the run of tokens at each position, by the hashes of the tokens; empty where there are fewer."""
    if len(h) < run:
        return np.zeros(0, dtype=np.int64)
    out = np.full(len(h) - run + 1, run, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(run):
            x = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = x ^ (x >> np.uint64(31))
    return out.view(np.int64)


def _words(blocks: Iterable[str]) -> list[str]:
    return [w for b in blocks for w in b.split(" ")]


def covered(words: list[str], frame: np.ndarray, run: int) -> np.ndarray:
    """Which of a page's words lie inside a run of the frame."""
    edge = np.zeros(len(words) + run + 1, dtype=np.int64)
    if len(frame):
        starts = np.flatnonzero(np.isin(run_hashes(word_hashes(words), run), frame))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[: len(words)] > 0


def page_text(zones: str, blocks: list[str], gone: np.ndarray) -> list[str]:
    """The blocks of a page's text, by the zones of its blocks (a, m or o) and which of its words are frame."""
    sizes = [b.count(" ") + 1 for b in blocks]
    ends = np.cumsum([0, *sizes])
    frame = [gone[i:j].mean() >= EDGE_SHARE for i, j in zip(ends[:-1], ends[1:], strict=True)]
    kinds = [z for z in "amo" if z in zones]
    size = lambda kind, own: sum(n for z, n, f in zip(zones, sizes, frame, strict=True) if z == kind and not (own and f))
    kind = kinds[0] if kinds else "o"
    if kinds and not size(kind, True):
        kind = next((k for k in kinds[1:] if size(k, True) > size(kind, False)), kind)
    found = [(b, f) for z, b, f in zip(zones, blocks, frame, strict=True) if z == kind]
    own = [i for i, (_, f) in enumerate(found) if not f]
    if kind == "o" and own:
        found = found[own[0] : own[-1] + 1]
    return [b for b, _ in found]


#: The result of counting a chunk.
COUNTS = "host string, chunks long, kind string, run long, pages long"


def _counts(pdf: pd.DataFrame, found: list[tuple[str, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(host, chunks, kind, run, pages) of a chunk's counts (kind, runs, pages)."""
    runs, pages = [np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] for f in found)]) for i in (1, 2)]
    kinds = np.array([kind for kind, r, _ in found for _ in range(len(r))], dtype=object)
    at = [0] * len(runs)
    return pd.DataFrame({"host": pdf["host"].iloc[at].to_numpy(), "chunks": pdf["chunks"].iloc[at].to_numpy(), "kind": kinds, "run": runs, "pages": pages})


def _candidates(run: int, share: float):
    """The runs that a share of a chunk's distinct pages have, of those pages that own (digest) names."""

    def count(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        for kind, group in pdf[pdf["digest"].isin(own["digest"])].drop_duplicates("digest").groupby("kind"):
            pages = [_words(b) for b in group["blocks"]]
            tokens, names = pd.factorize(np.array([w for p in pages for w in p], dtype=object))
            counts = repeated_runs(tokens, np.repeat(np.arange(len(pages)), [len(p) for p in pages]), run)
            # a run that one page has is no candidate where the chunk is its whole host
            at = np.flatnonzero(counts >= max(2 if group["chunks"].iloc[0] == 1 else 1, share * len(pages)))
            if len(at):
                runs, first = np.unique(run_hashes(word_hashes(names)[tokens], run)[at], return_index=True)
                found.append((kind, runs, counts[at][first]))
        return _counts(pdf, found)

    return count


def _recounter(run: int):
    """In how many of a chunk's own distinct pages each candidate is; notes name both, pages (digest) and candidates (kind, run)."""

    def count(pdf: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        pages = pdf[pdf["digest"].isin(notes["digest"].dropna())].drop_duplicates("digest")
        found = []
        for kind, group in notes.dropna(subset=["kind"]).groupby("kind"):
            runs = np.unique(np.array([int(r) for r in group["run"]], dtype=np.int64))
            counts = np.zeros(len(runs), dtype=np.int64)
            for blocks in pages["blocks"][pages["kind"] == kind]:
                counts += np.isin(runs, run_hashes(word_hashes(_words(blocks)), run))
            found.append((kind, runs[counts > 0], counts[counts > 0]))
        return _counts(pdf, found)

    return count


def _by_kind(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    return {kind: runs.to_numpy() for kind, runs in frame.groupby("kind")["run"]}


def _copies(run: int, copy_share: float):
    """(host, digest) of the pages that are mostly frame."""

    def find(pdf: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        runs, out = _by_kind(frame), []
        for kind, group in pdf.drop_duplicates("digest").groupby("kind"):
            if kind in runs:
                out += [(h, d) for h, d, b in zip(group["host"], group["digest"], group["blocks"], strict=True) if len(b) and covered(_words(b), runs[kind], run).mean() > copy_share]
        return pd.DataFrame(out, columns=["host", "digest"])

    return find


def _writer(run: int):
    """(id, url, text) of a chunk's pages."""
    none = np.zeros(0, dtype=np.int64)

    def write(pdf: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        runs = _by_kind(frame)
        texts = [" ".join(page_text(z, list(b), covered(_words(b), runs.get(k, none), run))) for k, z, b in zip(pdf["kind"], pdf["zones"], pdf["blocks"], strict=True)]
        return pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": np.array(texts, dtype=object)})

    return write


def _meet(table: DataFrame, side: DataFrame, *columns: str):
    """Each chunk of the table, by these columns, beside its rows of the side."""
    return table.select("host", "chunk", *columns).groupBy("host", "chunk").cogroup(side.groupBy("host", "chunk"))


def _spread(runs: DataFrame) -> DataFrame:
    """Runs (host, chunks, kind, run) for each chunk of their host; a frame is at most as long as 1 / share pages, so copies are few."""
    return runs.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "kind", "run")


def _frames(table: DataFrame, own: DataFrame, base: str, run: int, share: float, least: int) -> DataFrame:
    """(host, chunks, kind, run) of the frame, by the distinct pages (host, chunks, kind, digest, chunk) that count."""
    found = _meet(table, own.select("host", "chunk", "digest"), "chunks", "kind", "digest", "blocks").applyInPandas(_candidates(run, share), COUNTS)
    found = stored(found, f"{base}-found")
    counts = found.where("chunks = 1").select("host", "kind", "run", "pages")
    dealt = found.where("chunks > 1")
    if not dealt.isEmpty():
        # runs as text, since longs beside nulls would be rounded in tasks
        none = F.lit(None).cast("string")
        notes = _spread(dealt.select("host", "chunks", "kind", "run").distinct()).select("host", "chunk", "kind", F.col("run").cast("string").alias("run"), none.alias("digest"))
        mine = own.where("chunks > 1").select("host", "chunk", none.alias("kind"), none.alias("run"), "digest")
        each = _meet(table.where("chunks > 1"), notes.union(mine), "chunks", "kind", "digest", "blocks").applyInPandas(_recounter(run), COUNTS)
        counts = counts.union(each.groupBy("host", "kind", "run").agg(F.sum("pages").alias("pages")))
    sizes = own.groupBy("host", "chunks", "kind").agg(F.count("*").alias("n"))
    frame = counts.join(sizes, ["host", "kind"]).where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("n"))))
    return stored(frame.select("host", "chunks", "kind", "run"), base)


def site_frames(table: DataFrame, base: str, run: int = RUN, share: float = FRAME_SHARE, least: int = FRAME_PAGES, copy_share: float = COPY_SHARE) -> DataFrame:
    """(host, chunks, kind, run) of the frames of all hosts, near copies left out of the counts."""
    own = table.where("zones <> ''").groupBy("host", "chunks", "kind", "digest").agg(F.min("chunk").alias("chunk"))
    own = stored(own, f"{base}/own")
    frames = _frames(table, own, f"{base}/frames", run, share, least)
    if frames.isEmpty():
        return frames
    near = _meet(table, _spread(frames), "kind", "digest", "blocks").applyInPandas(_copies(run, copy_share), "host string, digest string")
    near = stored(near.distinct(), f"{base}/near")
    if near.isEmpty():
        return frames
    # hosts with near copies are counted again without them
    again = near.select("host").distinct()
    counted = stored(own.join(again, "host", "left_semi").join(near, ["host", "digest"], "left_anti"), f"{base}/counted")
    return stored(frames.join(again, "host", "left_anti").union(_frames(table, counted, f"{base}/frames2", run, share, least)), f"{base}/last")


def _parser(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [[(z[0], t) for z, t in blocks_of(h) if z in ("article", "main", "open")] for h in pdf["html"]]
        zones = ["".join(z for z, _ in b) for b in got]
        yield pdf.drop(columns="html").assign(kind=["open" if set(z) <= {"o"} else "main" for z in zones], zones=zones, blocks=[[t for _, t in b] for b in got])


def _dealt(rows: DataFrame, base: str, chunk_bytes: int) -> DataFrame:
    """rows (id, url, host, html) parsed, with chunk and chunks, the number of their host's chunks: a table bucketed by host and chunk, so that its texts are not exchanged again."""
    spark = rows.sparkSession
    hosts = stored(rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("n")), f"{base}/hosts")
    total = hosts.agg(F.sum("bytes")).first()[0] or 0
    # Spark exchanges a table of fewer buckets than shuffle partitions
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS, -(-total // BUCKET_BYTES)))
    big = stored(hosts.where(F.col("bytes") > chunk_bytes).select("host", F.least(F.ceil(F.col("bytes") / chunk_bytes), "n").cast("long").alias("chunks")), f"{base}/big")
    many = F.coalesce("chunks", F.lit(1).cast("long"))
    # equal rows are dealt apart too; the texts do not depend on the chunk
    dealt = rows.join(big, "host", "left").select("id", "url", "host", many.alias("chunks"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), many).alias("chunk"), "html")
    parsed = dealt.mapInPandas(_parser, "id string, url string, host string, chunks long, chunk long, kind string, zones string, blocks array<string>")
    parsed = parsed.withColumn("digest", F.sha2(F.concat_ws("\n", "zones", F.array_join("blocks", "\n")), 256))
    name = base.rpartition("/")[2].replace("-", "_")
    parsed.write.bucketBy(buckets, "host", "chunk").option("path", f"{base}/parsed").format("parquet").saveAsTable(name)
    table = spark.table(name)
    # forgets the name and leaves the files
    spark.sql(f"DROP TABLE {name}")
    return table


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, url, text) of every row of pages; text is empty where there is none.

    Null and empty html give empty text, null urls and urls without a host one
    host of their own. Repeated rows are one page for the counts and keep a row
    each. An empty table gives no rows. Whole texts are kept; nothing is capped.
    """
    base = scratch(pages.sparkSession)
    # ids as text, since longs beside nulls would be rounded in tasks
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    table = _dealt(rows, base, chunk_bytes)
    frames = site_frames(table, base)
    texts = _meet(table, _spread(frames), "id", "url", "kind", "zones", "blocks").applyInPandas(_writer(RUN), "id string, url string, text string")
    return texts.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), F.col("url").alias(url_col), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
