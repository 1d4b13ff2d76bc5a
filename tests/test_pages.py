"""Element trees, references against a base, publication dates and the frontier of the crawl loop."""

import duckdb
import pytest
from pyspark.sql import functions as F

from searchlake.catalog import all_oracles, all_queries
from searchlake.functions import html as H
from searchlake.functions import text as T
from searchlake.functions import url as U
from searchlake.operators import ingest
from searchlake.streaming import streams as S

LONG, SHORT = "long words " * 60, "few words"

# the examples of RFC 3986, section 5.4, against http://a/b/c/d;p?q
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_of_the_standard(spark):
    rows = spark.createDataFrame([("http://a/b/c/d;p?q", r) for r in RFC] + [("http://a", "g"), ("http://a?x", "g"), ("http://a", ""), ("nothing", "g"), (None, "g"), ("http://a/b", None)], "base string, ref string")
    got = {(r.base, r.ref): r.link for r in rows.withColumn("link", U.resolved(U.url_parts(F.col("base")), U.url_parts(F.col("ref")))).collect()}
    assert {r: got["http://a/b/c/d;p?q", r] for r in RFC} == RFC
    assert (got["http://a", "g"], got["http://a?x", "g"], got["http://a", ""], got["nothing", "g"], got[None, "g"], got["http://a/b", None]) == ("http://a/g", "http://a/g", "http://a", None, None, None)


def test_links_of_a_page(spark):
    page = """<a href="z.html">1</a><A HREF='../w'>2</A><a href=//b.org/q>3</a><a href="?p=2&amp;q">4</a><a href=" /t\n ">5</a><a name=x>no</a><a href="#top">no</a><a href="mailto:x@y">no</a>
        <a href="a.PDF">no</a><a href="/t/">again</a><!-- <a href="/comment">no</a> --><script>'<a href="/script">'</script><a href="ftp://c.org/">no</a><a href="HTTP://D.org/e">6</a>"""
    rows = spark.createDataFrame([(1, "https://a.org/x/y", page), (2, "no base", page), (3, None, page), (4, "https://a.org", None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.pos, r.link) for r in ingest.page_links(rows).collect())
    assert got == [(1, 0, "https://a.org/x/z.html"), (1, 1, "https://a.org/w"), (1, 2, "https://b.org/q"), (1, 3, "https://a.org/x/y?p=2&q"), (1, 4, "https://a.org/t"), (1, 10, "http://d.org/e")]


@pytest.mark.parametrize(
    "page, content, one_shot",
    [
        (f"<article><p>{LONG}</p></article>", LONG.strip(), LONG.strip()),
        (f"<body>menu<article><p>{SHORT}</p></article> end", f"menu {SHORT} end", f"menu {SHORT}  end"),
        (f"<main>{SHORT}<main>inner {LONG}</main> tail</main>", f"{SHORT} inner {LONG.strip()} tail", f"{SHORT} inner {LONG}  tail"),
        (f"<main>{LONG}</main><article>{LONG}x</article>", LONG.strip(), LONG.strip()),
        (f"<main>{SHORT}</main><article>{LONG}x</article>", f"{LONG}x", f"{LONG}x"),
        (f"<div class='a content b'>{LONG}1</div><div id=content>{LONG}2</div>", f"{LONG}1", f"{LONG}1"),
        (f"<div class='contents'>{LONG}1</div><div id=content>{LONG}2</div>", f"{LONG}2", f"{LONG}2"),
        (f"<p>x<div class=post>{LONG}p</div><div class=entry>{LONG}e</div>", f"{LONG}p", f"x {LONG}p {LONG}e"),
        (f"<p>x<div class=post>{SHORT}</div><div class=entry>{LONG}e</div>", f"{LONG}e", f"x {SHORT} {LONG}e"),
        (f"<p>x<div class=article-body>{LONG}</div>", LONG.strip(), f"x {LONG.strip()}"),
        # the last one that fits wins, even if it is shorter than one before
        (f"<article>{'word ' * 50}</article><div class=entry>tiny</div>", f"{'word ' * 50}tiny", ("word " * 50).strip()),
        ("<title>no body</title>", "", ""), ("", "", ""), (None, "", ""), ("a &lt;b&gt; &amp;amp; &eacute;<br>c", "a <b> &amp; é c", "a <b> &amp; é c"),
        ("<ul><li>one<li>two<ul><li>deep</ul><li class=content>three</ul>after", "one two deep three after", "one two deep three after"),
        ("<p class=content>in<p>out", "in out", "in out"), ("<div class=content>x</body></html> y", "x y", "x  y"), ("text <3 and > & more", "text <3 and > & more", "text <3 and > & more"), ("a<!-- <main>no</main> -->b", "a b", "a b"),
    ],
)
def test_content_by_selectors(page, content, one_shot):
    found = H.facts(page, 6500)
    assert found["content"] == content[:6500] and found["raw_len"] == len(content) and found["one_shot"] == one_shot[:5000]


def test_titles_and_raw_texts():
    assert H.facts("<title>a &amp; <b>b</b></title><script>if (1 < 2) '</p>'</script>x", 100)["title"] == "a & <b>b</b>"
    assert H.facts("<textarea><a href=x></textarea><style><a href=y></style><a href='z'>", 100)["hrefs"] == ["z"]
    page = H.parse("<table><tr><td id=a>1<td id=b>2<tr><td id=c>3</table><dl><dt>t<dd class=d>u<dt>v</dl>")
    assert [page.text(page.first(s)) for s in ("#a", "#b", "#c", ".d")] == ["1", "2", "3", "u"]
    assert H.parse("<meta name='date' content=x>").first("meta[name='date']").attributes["content"] == "x" and page.first("p") is None


def test_every_source_of_a_date_in_its_order(spark):
    mark = lambda i, day: f"<meta {H.DATES[i][0][5:-1]} content='{day}'>" if i < 7 else f"<time datetime='{day}'>x</time>"
    urls = ["https://a.org/2010/09/09/x", "https://a.org/2010/10/x", "https://a.org/x-2010-11-11"]
    rough = lambda y, m, d: ((y - 1970) * 365 + (m - 1) * 30 + d) * 86400
    rows, want = [], []
    for i in range(8):  # a mark comes before all later ones and before the url
        rows.append((urls[0], "".join(mark(k, f"2009-{k + 1:02d}-05T10:00:00Z") for k in reversed(range(i, 8)))))
        want.append(rough(2009, i + 1, 5))
    rows += [(urls[0], mark(0, "1999-01-01") + mark(3, "2031-01-01") + mark(7, " 2003-02-01z")), (urls[0], mark(2, "soon")), (urls[1], ""), (urls[2], None), ("https://a.org/2040/01/01/2010-11-12", ""), ("https://a.org/", ""), (None, "")]
    want += [rough(2003, 2, 1), rough(2010, 9, 9), rough(2010, 10, 1), rough(2010, 11, 11), rough(2010, 11, 12), None, None]
    rows += [(urls[0], mark(0, "2013-13-01")), (urls[0], mark(0, "2013-12-32")), ("https://a.org/", mark(0, "2000-01-01")), ("https://a.org/", mark(0, "2030-12-31"))]
    want += [rough(2010, 9, 9), rough(2010, 9, 9), rough(2000, 1, 1), rough(2030, 12, 31)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = H.extracted(df, want=("dates",)).select("page_id", T.publication(F.col("dates"), F.col("url")).alias("t")).orderBy("page_id").collect()
    assert [r.t for r in got] == want


def batch_of(spark, folder, number, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/tmp-{number}")
    import glob
    import os

    os.makedirs(f"{folder}/landing", exist_ok=True)
    os.rename(glob.glob(f"{folder}/tmp-{number}/part-*.parquet")[0], f"{folder}/landing/{number}.parquet")


def frontier_of(spark, folder):
    return [(r.url, r.batch) for r in spark.read.parquet(f"{folder}/frontier").orderBy("batch", "url").collect()]


def test_frontier_remembers_all_batches(spark, tmp_path):
    """Three batches of pages that link in a circle give each URL once, also if the last batch is run again."""
    folder = str(tmp_path)
    link = lambda *urls: "".join(f"<a href='{u}'>x</a>" for u in urls)
    batches = [[(1, "https://a.org/1", link("/2", "/3", "/1"))], [(2, "https://a.org/2/", link("/1", "/3", "/4"))], [(3, "https://a.org/3", link("/1", "/2", "/4", "/5", "/3"))]]
    for number, rows in enumerate(batches):
        batch_of(spark, folder, number, rows)
        S.crawl_loop(spark, f"{folder}/landing", f"{folder}/index", f"{folder}/frontier", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination(120)
    want = [("https://a.org/2", 0), ("https://a.org/3", 0), ("https://a.org/4", 1), ("https://a.org/5", 2)]
    assert frontier_of(spark, folder) == want
    # the run ends after the batch has written and before it is committed: it runs again
    import os

    for name in os.listdir(f"{folder}/ckpt/commits"):
        if name.strip(".").startswith("2"):
            os.remove(f"{folder}/ckpt/commits/{name}")
    S.crawl_loop(spark, f"{folder}/landing", f"{folder}/index", f"{folder}/frontier", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination(120)
    assert frontier_of(spark, folder) == want


def test_a_full_frontier_takes_no_more(spark, tmp_path):
    folder = str(tmp_path)
    link = lambda *urls: "".join(f"<a href='{u}'>x</a>" for u in urls)
    batches = [[(1, "https://a.org/1", link("/2", "/3", "/4", "/5"))], [(9, "https://a.org/9", link("/10"))], [(2, "https://a.org/2", link("/20")), (3, "https://a.org/3", link("/30"))], [(4, "https://a.org/4", link("/40"))]]
    for number, rows in enumerate(batches):
        batch_of(spark, folder, number, rows)
        S.crawl_loop(spark, f"{folder}/landing", f"{folder}/index", f"{folder}/frontier", f"{folder}/ckpt", most=5).trigger(availableNow=True).start().awaitTermination(120)
    # four of five wait when the second batch comes; two wait when the third comes
    assert frontier_of(spark, folder) == [(f"https://a.org/{k}", b) for k, b in ((2, 0), (3, 0), (4, 0), (5, 0), (20, 2), (30, 2), (40, 3))]


def test_references_that_are_cut_stay_as_written(spark, tmp_path):
    """As the statements have it, only what ends with a semicolon is a reference."""
    assert H.facts("<article>a &amp</article> b &copy; &#233; &#xe9; &nosuch; &notit; &copy=1", 100)["content"] == "a &amp b © é é &nosuch; &notit; &copy=1"
    assert H.facts("<a href='/x?a=1&copy=2&amp;b=3'>y</a>", 100, ("hrefs",))["hrefs"] == ["/x?a=1&copy=2&b=3"]
    page = f"<title>t</title><article><h1>R&amp</h1>{'word ' * 120}</article>"
    spark.createDataFrame([(1, "https://a.org/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_main_text", "one_shot_crawl"):
        assert [tuple(r) for r in all_queries()[name](spark, str(tmp_path)).collect()] == con.execute(all_oracles()[name]).fetchall()
