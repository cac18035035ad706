from pyspark.sql import functions as F

from brackwater.functions import pages, urls
from brackwater.operators import links

SHAPES = {
    "https://a.test/": (False, False, False, False), "https://a.test/recalls": (False, False, False, True), "https://a.test/x/index.html": (False, False, False, True),
    "https://a.test/news/2024/oat-bar-17.html": (False, True, True, False), "https://a.test/n/12345": (False, True, True, False), "https://a.test/static/app/1234": (True, False, False, False),
    "https://a.test/a/b/c": (False, False, True, False), "https://a.test/___portal/x/y": (False, True, True, False), "https://a.test/x/list_node.html": (False, False, False, True), None: (None, False, False, False),
}


def test_shapes(spark):
    df = spark.createDataFrame([(u,) for u in SHAPES], "u string")
    u = F.col("u")
    got = {r.u: (r.a, r.d, r.p, r.l) for r in df.select("u", pages.asset(u).alias("a"), pages.detail(u).alias("d"), pages.probable_detail(u).alias("p"), pages.listing(u).alias("l")).collect()}
    assert got == SHAPES


def test_neighbours_against_brute_force(spark):
    rows = [("s", f"https://a.test/recalls/r{i}/x") for i in range(6)] + [("s", "https://a.test/recalls"), ("s", "https://a.test/about/us"), ("t", "https://a.test/recalls/only")]
    df = spark.createDataFrame(rows, "source string, url string")
    hub = {(r.source, r.url): r.hub for r in links.hub_points(df).collect()}
    for source, url in rows:
        first = "/" + url.split("/")[3] + "/"
        under = sum(1 for s, u in rows if s == source and u != url and ("/" + u.split("/", 3)[3] + "/").startswith(first))
        assert hub[source, url] == (min(under, 12) if under >= 3 else 0)
    cluster = {r.url: r.cluster for r in links.cluster_points(spark.createDataFrame([("s", f"https://a.test/p/q/n{i}") for i in range(4)], "source string, url string")).collect()}
    assert set(cluster.values()) == {3}


def test_keywords_and_fragments(spark):
    parts = urls.path_parts(F.col("u"))
    df = spark.createDataFrame([("https://a.test/___p/x/y",), ("https://a.test/one",), (None,)], "u string")
    assert [r.f for r in df.select(pages.fragments(parts).alias("f")).collect()] == [["/___p/", "/___p/x/", "/x/"], ["/one/"], []]
    rows = [("s", f"https://a.test/recalls/{i}000/x") for i in range(3)] + [("s", "https://a.test/static/9999/y"), ("e", "https://a.test/")]
    got = [r.fragment for r in links.inferred_keywords(spark.createDataFrame(rows, "source string, url string")).orderBy("rank").collect()]
    assert got == ["/recalls/"]
    assert links.inferred_keywords(spark.createDataFrame([], "source string, url string")).count() == 0
