from pyspark.sql import functions as F

from brackwater.functions import urls
from brackwater.operators import pages_html as ph

PAGE = """<!DOCTYPE html><html lang="fr"><head><title> A &amp; B\n page </title><meta property="article:published_time" content="2024-05-06T01:00:00Z">
<script type="application/ld+json">{"@graph": [{"datePublished": " 2024-05-07 ", "x": {"dateCreated": "2024-05-08"}}]}</script><script>var hidden = 1</script></head>
<body><nav>Menu <a href="/a/a/b">Repeated</a><a href="mailto:x">mail</a></nav><main><h1>Big <i>head</i></h1><h2>Second</h2>
<p>Text &eacute; here <time datetime="2024-05-09">9 May</time></p><a href="//Other.test/x#frag">Away</a><a href="?p=2">next</a><a href="?p=2">again</a></main><footer>End</footer></body></html>"""


def test_facts():
    url, title, lang, headings, text, dates, times, links, anchors, scripts = ph.facts_of("https://s.test/dir/page", PAGE)
    assert (title, lang, anchors, scripts) == ("A & B page", "fr", 5, 2) and headings == ["<h1>Big head</h1>", "<h2>Second</h2>"]
    assert text == "Big head Second Text é here 9 May Away next again" and times == ["9 May"]
    assert dates == ["2024-05-09", "2024-05-06T01:00:00Z", "2024-05-07", "2024-05-08"]
    assert [x["url"] for x in links] == ["https://s.test/a/b", "https://Other.test/x", "https://s.test/dir/page?p=2"] and links[1]["text"] == "Away"


def test_odd_pages(spark):
    rows = [("u1", None), ("u2", ""), ("u3", "<p>open <b>never closed"), ("u4", "plain"), ("u5", "<h1>Only</h1>" + "<a href='x'>y</a>" * 5000), (None, "<title></title>"), ("u6", '<script type="application/ld+json">{broken</script>')]
    got = {r.url: r for r in ph.page_facts(spark.createDataFrame(rows, "address string, body string"), "address", "body").collect()}
    assert got["u1"].title == "u1" and got["u2"].text == "" and got["u3"].text == "open never closed" and got["u4"].text == "plain"
    assert got["u5"].title == "Only" and got["u5"].anchors == 5000 and got[""].title == "" and got["u6"].date_values == []


def test_kinds(spark):
    df = spark.createDataFrame([("https://a.test/recalls/", 9), ("https://a.test/recalls/oat-12345", 9), ("https://a.test/about", 9), ("https://a.test/about", 2), ("https://a.test/recalls/x", 2)], "u string, n int")
    u = F.col("u")
    got = [r.k for r in df.select(ph.page_class(u, urls.path(u), F.col("n"), F.array(F.lit("/Recalls/"))).alias("k")).collect()]
    assert got == ["listing", "detail", "listing", "irrelevant", "detail"]
    row = spark.range(1).select(ph.is_listing(F.lit("Latest Warnings"), F.lit("/x"), F.lit(3)).alias("a"), ph.is_listing(F.lit("t"), F.lit("/x"), F.lit(4)).alias("b"), ph.needs_browser(F.lit('<DIV id="root"></div>'), F.lit("x" * 99), 10).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, True)
