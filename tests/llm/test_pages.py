import random
import re

from pyspark.sql import functions as F
from qualweave.llm import html_diff, url_trust

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{before}
<article><h1>Head &amp; more</h1><p>One&nbsp;two
 three<br>four<p>Five <b>six</b>&#8364;<!-- gone --><form><input value=1>Search</form><aside>Side</aside><ul><li>i<li>ii</ul>
<div class="comments"><p>Nice!</p></div><p>End</article>{after}<div id=sidebar>More</div><footer>&copy; x</footer>"""
TEXT = "Head & more\nOne two three four\nFive six€\ni\nii\nEnd"


def test_article_without_its_surroundings():
    texts, roles = html_diff.blocks(PAGE.format(before="", after=""))
    assert "\n".join(html_diff.difference((texts, roles), [])) == TEXT
    assert html_diff.blocks(None) == ([], []) and html_diff.blocks("") == ([], [])
    assert html_diff.blocks("a <b") == (["a"], [0]) and html_diff.blocks("1 < 2 &am")[0] == ["1 < 2 &am"]
    assert html_diff.blocks("<script>never closed <p>x") == ([], [])
    assert html_diff.blocks("<p title=it's>x</p>y")[0] == ["x", "y"]


def test_lcs_matches_table():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html_diff.lcs(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))


def test_open_lines_shared_with_the_nearest_page_go(spark):
    data = [
        (1, "http://H.example/x/1", "<div>Site menu</div><div>Story one</div><div>Imprint</div>"),
        (2, "http://h.example/x/2", "<div>Site menu</div><div>Story two</div><div>Imprint</div>"),
        (3, "http://other.example/x/1", "<div>Site menu</div><div>Story three</div>"),
        (4, "http://h.example/art", PAGE.format(before="<p>Open a</p>", after="<p>Open b</p>")),
        (5, None, None),
        (6, "nowhere", "<p>x</p>"),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_diff.extract(pages.repartition(1)).collect()}
    assert got[1].text == "Story one" and got[2].text == "Story two" and got[3].text == "Site menu\nStory three"
    assert got[4].text == f"Open a\n{TEXT}\nOpen b" and got[5].text == "" and got[6].text == "x"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].url == data[0][1]
    assert html_diff.extract(pages.limit(0)).count() == 0


def plain_host(url):
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].translate({c: c + 32 for c in range(65, 91)}) if m else ""


def plain_path(url):
    m = re.match(r"(?s).*?://[^/?#]*([^?#]*)", url or "")
    return m[1] if m else ""


def brute_texts(data):
    """Neighbours by scanning the whole sorted list both ways."""
    rows = sorted(((plain_host(u), plain_path(u), i if i is not None else -(1 << 63), u or "", h or "", i) for i, u, h in data), key=lambda r: r[:5])
    out = []
    for k, (host, path, _, url, page, i) in enumerate(rows):
        beside = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(rows) and rows[j][0] == host and rows[j][4] == page:
                j += step
            beside.append((rows[j][1], html_diff.blocks(rows[j][4])) if 0 <= j < len(rows) and rows[j][0] == host else None)
        out.append((i, "\n".join(html_diff.difference(html_diff.blocks(page), html_diff.by_nearness(path, *beside)))))
    return sorted(out, key=repr)


def test_texts_do_not_depend_on_partitions(spark, small):
    rng = random.Random(5)
    menu = "<div>Home</div><div>About us</div>"
    data = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    for i in range(150):
        host, k = rng.choice(("a.test", "a.test", "b.test")), rng.randrange(40)
        body = f"<div>Story {k} of {host} is a rather long line of text</div>"
        data.append((9000 + i, f"http://{host}/s/{k}{rng.choice(('', '?x', '/'))}", f"{menu}{body}<div>Imprint</div>"))
    data += [(9500 + i, f"http://hot.test/{i % 3}", f"{menu}<div>The same story on every page</div>") for i in range(60)] + [(9700, "http://hot.test/1/9", f"{menu}<div>Another story</div>")]
    data += [(9700, "http://hot.test/1/9", f"{menu}<div>Another story</div>"), (None, None, None), (1, None, "<p>x"), (9900, "http://long.test/", "<p>word</p>" * 20_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "part": F.lit(1), "content": F.lit("c"), "text": F.lit("t")})
    expected = brute_texts(data)
    assert dict(expected)[9500] == "The same story on every page" and dict(expected)[9700] == "Another story"
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html_diff.extract(pages.repartition(3)).collect()
            assert sorted(((r.page_id, r.text) for r in got), key=repr) == expected, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_structure_has_a_veto():
    page = "<header>Site</header><article><header><h1>Title</h1></header><p class=header>Lead</p><section id=replies-explained>On replies</section><div class='reader-comments'>Me too</div></article><div class='site-footer top'>(c)</div>"
    assert html_diff.difference(html_diff.blocks(page), [html_diff.blocks(page)]) == ["Title", "Lead", "On replies"]
    one, two = "<div>Menu</div><div>A story that is long enough</div>", "<div>Menu</div><div>Quite another story, and long</div>"
    assert html_diff.difference(html_diff.blocks(one), [html_diff.blocks(one), html_diff.blocks(two)]) == ["A story that is long enough"]
    assert html_diff.difference(html_diff.blocks(one), [html_diff.blocks(one)]) == ["Menu", "A story that is long enough"]


def brute_ranks(seeds, edges, n=300):
    total = {}
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    rank = {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(n):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for a, b, w in edges:
            new[b] = new.get(b, 0.0) + 0.85 * rank.get(a, 0.0) * w / total[a]
        rank = new
    return rank


def test_rank_matches_brute_force(spark):
    seeds = {"a": 1.0, "b": 0.5, "c": 0.0}
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "d", 3), ("d", "a", 1)] + [("c", "h0", 1)] + [(f"h{k}", f"h{k + 1}", 1) for k in range(20)]
    got = url_trust.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), spark.createDataFrame(edges, "src string, dst string, links long"))
    expected = brute_ranks(seeds, edges)
    assert {r.host: round(r["rank"], 4) for r in got.collect()} == {h: round(v, 4) for h, v in expected.items()}


def test_rules_and_method(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p?q#r">l</a>' for h in hosts)
    data = [
        (1, "https://a.Example.NET/en/1?x", ""),
        (2, "https://example.net/fr/1", ""),
        (3, "https://m.example.com/de/2#top", ""),
        (4, "https://notexample.com/de/2", link("bad.net")),
        (5, "https://x.org/fr/1", link("friend.info")),
        (6, "https://x.org/de/1", "<a href='/fr/2'>own</a>"),
        (7, "https://net", None),
        (8, "https://friend.info/", ""),
        (9, None, None),
        (10, "no scheme", ""),
        (11, "https://xnet/a", ""),
        (12, "http://bad.net?p=/en/", ""),
        (13, "http://bad.net/x", ""),
    ]
    got = {r.page_id: r for r in url_trust.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [got[k].rule for k in range(1, 14)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None, "net/"]
    assert [got[k].verdict for k in range(1, 14)] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "block"]
    assert (got[1].host, got[1].path) == ("a.example.net", "/en/1") and (got[12].host, got[12].path) == ("bad.net", "") and (got[9].host, got[9].path) == ("", "")
    assert got[4].distrust > 0 and got[8].trust > 0
    assert url_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    data = [(k, f"http://b{k}.net/x", "") for k in range(3)] + [(9, "http://farm.info/1", "<a href='http://b0.net/'>1</a><a href=//b1.net>2</a>")]
    got = {r.page_id: r for r in url_trust.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[9].rule is None and got[9].verdict == "block"


def brute_judge(data):
    """Rules by trying each; hosts of pages by their shares of pages; for tables without links between hosts."""
    shares, out = {}, {}
    for i, url, _ in data:
        h, p = plain_host(url), plain_path(url)
        fits = [t for t, _ in url_trust.RULES if (h == t.split("/")[0] or h.endswith("." + t.split("/")[0])) and p.startswith(t[t.index("/") :])]
        out[i] = (h, p, max(fits, key=len, default=None))
        shares.setdefault(h, []).append({None: 0, "allow": -1, "block": 1}[dict(url_trust.RULES).get(out[i][2])])
    said = lambda h, r: dict(url_trust.RULES)[r] if r else "block" if h and sum(shares[h]) / len(shares[h]) >= url_trust.THRESHOLD else "allow"
    return {i: (h, p, r, said(h, r)) for i, (h, p, r) in out.items()}


def test_judge_matches_brute_force_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    extra = [(10**6, "https://h.example.com/de/1?q", "x" * 300_000), (10**6 + 1, "https://h.example.com/de/2", None), (10**6 + 2, "HTTP://H.Example.COM/other", "<a href=''>"), (10**6 + 3, None, None)]
    data = [(r.page_id, r.url, None) for r in pages.collect()] + extra
    df = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumns({"host": F.lit("x"), "rule": F.lit(1), "rank": F.lit(2), "blocked": F.lit(True)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(df).collect()}
    assert got == brute_judge(data) and got[10**6 + 2][3] == "block"
    twice = url_trust.judge(df.where("page_id >= 1000000").unionAll(df.where("page_id >= 1000000")))
    assert twice.count() == 8
