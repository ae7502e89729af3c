"""HTML extraction, URL filters and WARC archives."""

import base64
import hashlib
import html as h
import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import SF, oracle, same

from tracewright.llm import html_extract as he
from tracewright.llm import url_filter as uf
from tracewright.llm import warc

SCHEMA = "page_id long, url string, html string, host string, text string"
EDGE = [(1, "http://a.b/x", "same", "k", "t"), (2, None, "same", "k", "t"), (3, "http://c", "\r\n\r\nWARC/1.1\r\n é€", "k", "t"), (4, "u\r\nv", None, "k", "t"), (5, "u", "", "k", "t"), (6, "http://h?q", "same", "k", "t"), (6, "http://h?q", "same", "k", "t"), (7, "http://h/", "<p>" + "long word " * 50_000, "k", "t"), (8, "http://h/2", "<article>a<br>b &amp; <b>c</b>d<script>x</script></article>tail", "k", "t")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_blocks():
    page = '<html><head><title>x</title></head><body><div class="site-header">H</div><nav>a<ul><li>b</ul></nav><div id="content"><p>Hello <b>wor</b>ld &amp; co<br>next<script>var x="</p>"</script><div class="ad">buy</div> tail<section class=comments><article>c</article></section></div><footer>f</footer><p>un</'
    assert [t for z, t in he.blocks_of(page) if z == "open"] == ["Hello world & co", "next", "tail", "un"]
    art = "<header>top</header><article><header><h1>T</h1></header><p>one<!-- no --> two</p><form>f</form><aside>s</aside><footer>x</footer></article><div role='complementary'>r</div>"
    assert he.main_blocks(he.blocks_of(art)) == ("main", ["T", "one two"])
    assert he.blocks_of("a < b <c") == [("open", "a < b")] or he.blocks_of("a < b <c")[0][1].startswith("a < b")


def test_many_unclosed_elements():
    page = "<div><article>" + "<p>one" * 5000 + "<div>two</div>three</article></div>tail" + "<li>x" * 100_000 + "</dl>" * 100_000
    kind, texts = he.main_blocks(he.blocks_of(page))
    assert (kind, texts) == ("main", ["one"] * 5000 + ["two", "three"])


def brute_runs(tokens, page, run):
    n = len(tokens)
    where = {}
    for i in range(n - run + 1):
        if page[i] == page[i + run - 1]:
            where.setdefault(tuple(tokens[i : i + run]), []).append(i)
    out = [0] * n
    for at in where.values():
        for i in at:
            out[i] = len({page[j] for j in at})
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_suffix_array(run):
    rng = np.random.default_rng(run)
    for n, kinds in ((0, 2), (1, 2), (60, 2), (60, 1), (300, 3), (300, 40)):
        tokens, page = rng.integers(0, kinds, n), np.sort(rng.integers(0, 6, n))
        assert he.repeated_runs(tokens, page, run).tolist() == brute_runs(tokens.tolist(), page.tolist(), run)
        order, common = he.suffix_array(tokens)
        suffixes = sorted((tokens[i:].tolist(), i) for i in range(n))
        assert order.tolist() == [i for _, i in suffixes]
        for k in range(1, n):
            a, b = suffixes[k - 1][0], suffixes[k][0]
            assert common[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_class_names_of_the_article():
    text = lambda p: he.main_blocks(he.blocks_of(p))
    assert text('<main class="has-sidebar"><p>hello</p></main>') == ("main", ["hello"])
    assert text('<article id="related" class="share widget"><p>a</p><div class="related-work">b</div><div class="related">c</div><div class="share-buttons">d</div></article>') == ("main", ["a", "b"])
    assert text('<div class="content has-sidebar"><article>x</article></div>') == ("main", ["x"])
    assert text('<div class="widget"><main>x<aside>y</aside></main></div><div class="main-nav">z</div>') == ("main", ["x"])
    assert text('<article>x<section class="comments"><article class="comment">y</article></section></article><article class="comment">z</article>') == ("main", ["x"])


def test_articles_are_never_trimmed(spark):
    """Twelve equal pages, or any share of near copies, keep every block of their article."""
    menu = "home products about us contact jobs press legal imprint"
    page = lambda i: f"<nav>{menu}</nav><article><h1>t</h1><p>{'same words again ' * 20}</p><p>read {i} times</p><p>{menu}</p></article><footer>{menu}</footer>"
    rows = [(i, "http://h/x", page(7 if i < 12 else i)) for i in range(40)]
    for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"] == " ".join(["t", *("same words again".split() * 20), f"read {7 if r['page_id'] < 12 else r['page_id']} times", menu])


def brute_open(pages, run=8):
    """Text of each page (host, blocks) by counting runs over all distinct pages of its host."""
    out = {}
    for host in {h for h, _ in pages}:
        distinct = {tuple(b) for h, b in pages if h == host}
        words = {p: " ".join(p).split() for p in distinct}
        grams = lambda p: [tuple(words[p][i : i + run]) for i in range(len(words[p]) - run + 1)]

        def gone(counted):
            n = {}
            for p in counted:
                for g in set(grams(p)):
                    n[g] = n.get(g, 0) + 1
            least = max(2, -(-len(counted) // 2))
            return {p: {i + j for i, g in enumerate(grams(p)) if n.get(g, 0) >= least for j in range(run)} for p in distinct}

        cut = gone(distinct)
        near = {p for p in distinct if len(cut[p]) > 0.8 * len(words[p])}
        if near:
            cut = gone(distinct - near)
        for p in distinct:
            at, frame = 0, []
            for b in p:
                n = len(b.split())
                frame.append(sum(i in cut[p] for i in range(at, at + n)) >= 0.8 * n)
                at += n
            own = [i for i, f in enumerate(frame) if not f]
            out[host, p] = " ".join(p[own[0] : own[-1] + 1] if own else p)
    return out


def test_inline_elements_break_no_words():
    text = lambda p: " ".join(he.main_blocks(he.blocks_of(p))[1])
    assert text("<p>foo<span>bar</span>baz, <span>5</span>. End</p>") == "foobarbaz, 5. End"
    assert text("<p>a<a href=x>b</a><em>c</em>d<svg><text>no</text></svg>e <button>no</button>f</p>g") == "abcde f g"
    assert text("<p>a<span class=ad>no<p>no</p></span>b<span hidden>no</p>c") == "ab c"
    assert text("<article>x<span class='promo'>no<div>no</div></span>y</article>") == "xy"


def test_adverts_and_notices_inside_articles():
    text = lambda p: " ".join(he.main_blocks(he.blocks_of(p))[1])
    for name in ("ad-slot", "cookie-banner", "newsletter-signup", "promo-text", "related-posts", "inline-ad", "article__ad", "sponsored-content", "share-buttons", "js-cookieNotice"):
        assert text(f"<article>a<div class='{name}'>no</div>b</article>") == "a b"
    for name in ("related-work", "has-ads", "no-ads", "admin", "shared-memory", "address-block", "commentary"):
        assert text(f"<article>a<div class='{name}'>yes</div>b</article>") == "a yes b"
    assert text("<main>x<article class='teaser card'>no</article>y</main>") == "x y"


@pytest.mark.parametrize("n", [2, 3, 5, 10, 14, 16, 30])
def test_shared_prose_stays_whatever_the_hosts_size(spark, n):
    menu, quote, foot = "home shop news about jobs press legal imprint terms", "it was a dark night and " * 8, "all rights are reserved by the owners of this site"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    page = lambda i: f"<div>{menu}</div><p>own beginning {own(i)}</p>{f'<p>{quote}</p>' if i < 3 else ''}<p>{own(1000 + i)}</p><div>{foot} {i % 7}</div>"
    rows = spark.createDataFrame([(i, "http://h/x", page(i)) for i in range(n)], "page_id long, url string, html string")
    for r in he.extract(rows).collect():
        i = r["page_id"]
        assert r["text"] == " ".join(f"own beginning {own(i)} {quote if i < 3 else ''} {own(1000 + i)}".split())


def test_frames_of_open_pages(spark):
    """Pages without article tags, where the array decides: the result is brute force's, however pages are dealt into chunks."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    pages = []
    for host, n in (("big.org", 60), ("small.org", 4), ("two.org", 2), ("mixed.org", 25)):
        menu, foot = [" ".join(word() for _ in range(k)) for k in (12, 20)]
        shared = " ".join(word() for _ in range(60))
        near = [" ".join(word() for _ in range(70)) for _ in range(2)]
        for i in range(n):
            own = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 4))]
            if host == "mixed.org" and i % 3 == 0:
                own = [*near, f"seen {i} times"]
            if i in (1, 2):
                own.append(shared)
            pages.append((host, [menu, *own, f"{foot} {i % 4}"]))
    pages += [pages[0]] * 5 + [("big.org", [pages[0][1][0]])]
    rows = [(i, f"http://{h}/{i}", "".join(f"<p>{b}</p>" for b in p)) for i, (h, p) in enumerate(pages)]
    rows += [(1000 + i, f"http://big.org/a{i}", f"<article>{pages[0][1][0]} {i}</article>") for i in range(30)]
    want = brute_open(pages)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for chunk in (300, 10_000, 10**9):
        got = {r["page_id"]: r["text"] for r in he.extract(df, chunk_bytes=chunk).collect()}
        assert len(got) == len(rows)
        for i, (h, p) in enumerate(pages):
            assert got[i] == want[h, tuple(p)]
    assert sum(len(want[h, tuple(p)].split()) < len(" ".join(p).split()) for h, p in pages) > 50


def repeated_articles():
    """Pages of hosts whose article elements are teasers, or near copies of one text, and what their text is."""
    words = lambda key, n: " ".join(f"{key}x{k}" for k in range(n))
    foot = words("foot", 12)
    rows, want = [], []
    for i in range(9):
        cards = "".join(f"<article class='card'><h2>{words(f'card{c}', 10)}</h2></article>" for c in range(3))
        prose = words(f"prose{i}", 50)
        rows.append(("cards.org", f"{cards}<div>{prose}</div><div>{foot}</div>"))
        want.append(prose)
        rows.append(("main.org", f"<main><p>{prose}</p>{cards}</main><div>{foot}</div>"))
        want.append(prose)
        # fewer words of its own than the repeated article has: a date, a counter
        rows.append(("copies.org", f"<article><p>{words('copy', 60)}</p></article><div>{words(f'seen{i}', 9)}</div>"))
        want.append(words("copy", 60))
        rows.append(("news.org", f"<article><p>{words('lead', 30)}</p><p>{prose}</p><p>{foot}</p></article><div>{words(f'aside{i}', 200)}</div>"))
        want.append(f"{words('lead', 30)} {prose} {foot}")
    return rows, want


def test_the_array_decides_which_article_is_the_pages_own(spark):
    """Article elements that half of a host's pages repeat are not the text of pages with more of their own beside them, however pages are dealt."""
    rows, want = repeated_articles()
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    for chunk in (2000, 10**9):
        got = {r["page_id"]: r["text"] for r in he.extract(df, chunk_bytes=chunk).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_frames_of_all_pages(spark, tmp_path):
    """The array counts the runs of every page, those with an article too, over each host's distinct pages of a template."""
    rows = [*repeated_articles()[0], *[("news.org", f"<div>{' '.join(f'menu{k}' for k in range(9))}</div><p>{' '.join(f'open{i}x{k}' for k in range(30))}</p>") for i in range(4)]]
    rows += rows[:1] * 30
    want = set()
    for host in {h for h, _ in rows}:
        for kind in ("main", "open"):
            blocks = {tuple(b for b in he.blocks_of(p) if b[0] not in ("drop", "off")) for h, p in rows if h == host}
            pages = [" ".join(t for _, t in b).split() for b in blocks if any(z in ("article", "main") for z, _ in b) == (kind == "main")]
            grams = [{tuple(w[i : i + 8]) for i in range(len(w) - 7)} for w in pages]
            for g in set().union(*grams):
                if sum(g in other for other in grams) >= max(2, len(pages) / 2):
                    want.add((host, kind, int(he.run_hashes(he.word_hashes(g), 8)[0])))
    df = spark.createDataFrame([(str(i), "u", h, p) for i, (h, p) in enumerate(rows)], "id string, url string, host string, html string")
    for chunk in (2000, 10**9):
        base = f"file://{tmp_path}/frames-{chunk}"
        got = he.site_frames(he._dealt(df, base, chunk), base, copy_share=1.0).select("host", "kind", "run").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) and {k for _, k, _ in want} == {"main", "open"}


def test_large_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "u", "<p>a</p>"), (None, "u", "<p>b</p>"), (-(2**62) - 1, None, None)]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert got.schema["page_id"].dataType.simpleString() == "bigint"
    assert {tuple(r) for r in got.collect()} == {(2**53 + 1, "u", "a"), (None, "u", "b"), (-(2**62) - 1, None, "")}


def test_extract_against_the_tables_markup(spark):
    rows = he.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_extract_edges(pages, nothing):
    got = [(r["page_id"], r["text"]) for r in he.extract(pages).collect()]
    assert len(got) == len(EDGE) and dict(got)[4] == "" and dict(got)[8] == "a b & cd" and len(dict(got)[7]) == 499_999
    assert he.extract(pages, chunk_bytes=10).count() == len(EDGE) and he.extract(nothing).count() == 0


def listed(url):
    rest = (url or "").split("://", 1)
    if len(rest) == 1:
        return "", "", None
    host = re.match(r"[^/?#]*", rest[1])[0]
    path = re.match(r"[^?#]*", rest[1][len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in uf.LIST if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return host, path, best


def test_urls_against_brute_force(spark, nothing):
    urls = ["http://Example.NET/en/1?x=1", None, "", "nohost", "https://a.example.com/de/1", "http://x.org/fr/a#b", "http://net", "http://net/", "http://notnet/", "http://a://b/c", "http://a.net?b/", "HTTP://ÄB.ORG/fr/", "http://x.example.net/en", "x://y.org/fr\n/z"]
    df = spark.createDataFrame([(i, u, "k", "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")
    for r in uf.judge(df, []).collect():
        host, path, best = listed(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.rule, best.verdict if best else "allow")
    assert uf.judge(nothing, [(("h:a",), 1.0)]).count() == 0
    tables = uf.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), "page_id").collect()
    assert all((r["host"], r["path"], r["rule"]) == (listed(r["url"])[0], listed(r["url"])[1], listed(r["url"])[2] and listed(r["url"])[2].rule) for r in tables)


def brute_rules(rows, support, confidence):
    """All rules of up to three tokens by counting every combination."""
    every = {}
    for n in (1, 2, 3):
        for c in combinations(sorted({t for r in rows for t in r[0]}), n):
            inside = [b for items, b in rows if set(c) <= set(items)]
            if sum(inside) >= support * len(rows) and sum(inside) / max(1, len(inside)) >= confidence:
                every[c] = sum(inside) / len(inside)
    return {c: x for c, x in every.items() if not any(set(o) < set(c) and y >= x for o, y in every.items())}


def test_rules_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        items = sorted({f"t{x}" for x in rng.integers(0, 6, 4)})
        rows.append((items, bool({"t1", "t2"} <= set(items)) or rng.random() < 0.05))
    # tokens of one template, some of which good rows have too
    rows += [([f"c{i}" for i in range(5)], True)] * 20 + [(["c0", "c1"], False)] * 3 + [(["c0", "c2"], False)] * 9
    df = spark.createDataFrame(rows, "items array<string>, bad boolean")
    got = uf.mine_rules(df, 0.02, 0.8, deviations=0)
    assert dict(got) == pytest.approx(brute_rules(rows, 0.02, 0.8)) and ("t1", "t2") in dict(got) and [c for _, c in got] == sorted((c for _, c in got), reverse=True)
    combos = [("t1", "t2"), ("t3",), ("t0", "t9")]
    for r in df.select("items", uf.matching(df["items"], combos).alias("m")).collect():
        assert sorted(r["m"]) == [i for i, c in enumerate(combos) if set(c) <= set(r["items"])]
    assert uf.mine_rules(df.limit(0)) == [] and uf.mine_rules(df.where("NOT bad")) == []


def test_a_template_of_many_tokens_is_mined_in_time(spark):
    """Forty tokens in all bad rows: one set for FP-growth, not 2^40."""
    rows = [([f"c{i:02d}" for i in range(40)], True)] * 50 + [([f"c{i:02d}" for i in range(0, 40, 2)], False)] * 50
    got = uf.mine_rules(spark.createDataFrame(rows, "items array<string>, bad boolean"), 0.02, 0.8)
    assert {k for k, _ in got} == {(f"c{i:02d}",) for i in range(1, 40, 2)}


def planted(spark, n=900):
    """Pages whose text is junk where two tokens of the URL meet, and never for one of them alone."""
    good = "the report of the day says that there is more to it than " + " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60))
    rows = []
    for i in range(n):
        shop, deal = i % 3 == 0, i % 2 == 0
        text = "$$ ** buy ## now || " * 40 if shop and deal else f"{good} {i}"
        rows.append((i, f"https://{'shop' if shop else 'www'}.h{i % 7}.example.com/{'deal' if deal else 'help'}/{i}", f"<article><p>{text}</p></article>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_from_what_pages_say(spark):
    pages = planted(spark)
    labels = uf.text_labels(pages)
    assert labels.count() == 900 and labels.where("bad").count() == 150
    rules = uf.mine_rules(uf.labelled_urls(pages, labels))
    assert [k for k, _ in rules] == [("h:shop", "p:deal")]
    out = uf.judge(pages.drop("html").union(spark.createDataFrame([(None, "https://shop.x/deal"), (5, None)], "page_id long, url string")), rules)
    for r in out.collect():
        bad = "shop." in (r["url"] or "") and "/deal" in r["url"]
        assert (r["mined"] is not None) == bad and r["verdict"] == ("block" if bad else "allow") or r["rule"]
    again = uf.judge(pages, rules, literal_rules=0).collect()
    assert sorted((r["page_id"], r["verdict"], str(r["mined"])) for r in again) == sorted((r["page_id"], r["verdict"], str(r["mined"])) for r in uf.judge(pages, rules).collect())
    drawn = uf.text_labels(pages, 100).count()
    assert 60 < drawn < 140


def test_few_pages_prove_no_rule(spark):
    rows = [(["h:a"], True)] * 3 + [(["h:b"], False)] * 50
    df = spark.createDataFrame(rows, "items array<string>, bad boolean")
    assert uf.mine_rules(df) == [] and uf.mine_rules(df, deviations=0) == [(("h:a",), 1.0)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_url_query_equals_sql(spark, sf):
    at = SF.replace("0.001", sf)
    got = uf.query(spark, at).toPandas()
    same(got, oracle(uf.SQL, at))
    assert got.mined.notna().sum() == 0


def test_warc_round_trip(spark, pages, nothing, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, captures_per_file=2)
    rows = warc.assemble(warc.read_records(spark, path, True)).collect()
    assert len(rows) == len(EDGE)
    bodies = {i: (b or "").encode() for i, _, b, *_ in EDGE}
    for r in rows:
        i = int(r["capture_id"])
        assert r["response"]["payload_bytes"] == len(bodies[i]) and r["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(bodies[i]).digest()).decode()
        assert r["kind"] == ("revisit" if i in (1, 2, 4) else "response") and r["refers_to"] == {1: 6, 2: 6, 4: 5}.get(i)
        assert r["n_request"] == r["n_metadata"] == 1 and (r["kind"] == "revisit" or r["response"]["payload"] == bodies[i])
    assert {r["target_uri"] for r in rows if r["capture_id"] == "4"} == {"u%0D%0Av"}
    warc.write_archives(pages, f"{path}2", min_bytes=1)
    kinds = [(int(r["capture_id"]), r["kind"]) for r in warc.assemble(warc.read_records(spark, f"{path}2")).collect()]
    assert dict(kinds)[4] == "response" and dict(kinds)[1] == "revisit"
    warc.write_archives(nothing, f"{path}3")
    assert warc.assemble(warc.read_records(spark, f"{path}3")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_warc_files_bound_by_bytes(spark, tmp_path):
    sizes = [0, 7, 8, 9, 100, 101, 128, 129, 130, 900, 3000] * 3
    bodies = {i: (f"{i:02d}" + "é" * n)[:n] for i, n in enumerate(sizes)}
    table = spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in bodies.items()], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(table, path, captures_per_file=40, small_bytes=8)
    records = warc.read_records(spark, path, True)
    rows = warc.assemble(records).collect()
    assert {int(r["capture_id"]) for r in rows} == set(bodies) and len(rows) == len(bodies)
    assert all(r["kind"] == "revisit" or r["response"]["payload"].decode() == bodies[int(r["capture_id"])] for r in rows)
    files = records.where("kind = 'response'").groupBy("file").agg({"payload_bytes": "sum", "*": "count"}).collect()
    assert all(f["sum(payload_bytes)"] <= 320 or f["count(1)"] == 1 for f in files) and max(f["count(1)"] for f in files) > 1


def test_warc_query_equals_sql(spark):
    same(warc.query(spark, SF).toPandas(), oracle(warc.SQL))
