"""Queries on links: their shapes, scores, ranks and the keywords inferred from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackwater.functions import pages, urls
from brackwater.operators import links
from brackwater.runtime import table
from brackwater.sources import tables as t

QUERIES, ORACLES = {}, {}
#: Links kept for a prompt, sampled children, seeds.
MOST_CANDIDATES, MOST_CHILDREN, MOST_SEEDS = 40, 40, 3


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def source_links(s, d):
    """(source, url): the distinct addresses of each source's alerts."""
    return table(s, d, "alerts").select(F.col("web_source").alias("source"), F.col("source_url").alias("url")).filter("url IS NOT NULL AND source IS NOT NULL").distinct()


_SHAPES = rf"""
l0 AS (SELECT DISTINCT web_source AS source, source_url AS url FROM alerts WHERE source_url IS NOT NULL AND web_source IS NOT NULL),
l1 AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM l0),
l2 AS (SELECT *, CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS slashed, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM l1),
l3 AS (SELECT *, regexp_matches(slashed, '{pages.ASSET_PATTERN}') AS asset, len(list_filter(parts, lambda x: regexp_matches(x, '[0-9]{{4,}}'))) > 0 AS long_id,
  len(list_filter(parts, lambda x: regexp_matches(regexp_replace(x, '\.[^.]*$', ''), '[0-9]{{3,}}|[a-zA-Z]{{1,6}}-\w*[0-9]'))) > 0 AS id_like,
  coalesce(parts[-1] IN ('index.html', 'home.html', 'home_node.html') OR parts[-1] LIKE '%\_node.html' ESCAPE '\', false) AS idx FROM l2),
l4 AS (SELECT *, len(parts) >= 2 AND NOT asset AND NOT idx AND (parts[1] LIKE '\_\_\_%' ESCAPE '\' AND len(parts) >= 3 OR len(parts) >= 3 AND id_like OR long_id
  OR parts[-1] LIKE '%.html' AND len(parts) >= 3 OR len(parts) >= 4) AS detail FROM l3),
l5 AS (SELECT *, NOT detail AND NOT asset AND len(parts) > 0 AND (idx OR len(parts) <= 2 AND NOT long_id) AS listing FROM l4),
shape AS (SELECT *, detail OR (NOT listing AND NOT asset AND len(parts) >= 2 AND NOT idx AND (len(parts) >= 3 OR id_like)) AS probable,
  CASE WHEN len(parts) >= 1 THEN '/' || parts[1] || '/' END AS p1, CASE WHEN len(parts) >= 2 THEN '/' || parts[1] || '/' || parts[2] || '/' END AS p2,
  regexp_extract(slashed, '^(/[^/]+/)', 1) AS w1, regexp_extract(slashed, '^(/[^/]+/[^/]+/)', 1) AS w2 FROM l5)"""
_SCORES = f"""{_SHAPES},
c1 AS (SELECT source, w1 AS at, count(*) AS n FROM shape WHERE w1 <> '' GROUP BY ALL), c2 AS (SELECT source, w2 AS at, count(*) AS n FROM shape WHERE w2 <> '' GROUP BY ALL),
beside AS (SELECT s.*, coalesce(c1.n, 0) - CASE WHEN p1 = w1 THEN 1 ELSE 0 END AS u1, coalesce(c2.n, 0) - CASE WHEN p2 = w2 THEN 1 ELSE 0 END AS u2
  FROM shape s LEFT JOIN c1 ON c1.source = s.source AND c1.at = p1 LEFT JOIN c2 ON c2.source = s.source AND c2.at = p2),
points AS (SELECT *, CASE WHEN u1 >= 3 THEN least(u1, 12) WHEN u2 >= 3 THEN least(u2, 12) ELSE 0 END AS hub,
  CASE WHEN probable AND len(parts) >= 2 AND u2 >= 2 THEN least(u2, 8) ELSE 0 END AS cluster FROM beside),
scored AS (SELECT *, CASE WHEN asset THEN -20 ELSE CASE WHEN path IN ('', '/') THEN -1 ELSE 0 END + CASE WHEN detail THEN -10 WHEN listing THEN 8 WHEN len(parts) <= 2 THEN 2 ELSE 0 END
  + CASE WHEN len(parts) >= 4 THEN -3 ELSE 0 END + hub END AS score,
  CASE WHEN asset THEN -20 ELSE CASE WHEN probable THEN 20 WHEN listing THEN -8 ELSE 0 END + CASE WHEN len(parts) >= 3 THEN 3 ELSE 0 END + CASE WHEN id_like THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(path, '[0-9]{{3,}}') THEN 2 ELSE 0 END + cluster END AS notice FROM points)"""


def _shape(name: str, column: str, spark_column) -> None:
    @query(name, f"WITH {_SHAPES} SELECT source, url, {column} AS found FROM shape")
    def _(s, d):
        return source_links(s, d).select("source", "url", spark_column(F.col("url")).alias("found"))


_shape("ur08_asset_urls", "asset", pages.asset)
_shape("ur09_detail_urls", "detail", pages.detail)
_shape("ur10_probable_urls", "probable", pages.probable_detail)
_shape("ur11_listing_urls", "listing", pages.listing)
_shape("ur12_long_ids", "long_id", lambda u: pages.long_numeric(urls.path_parts(u)))
_shape("ur12_id_like", "id_like", lambda u: pages.id_like(urls.path_parts(u)))
_shape("ur14_under_recalls", "slashed LIKE '/recalls/%'", lambda u: pages.under_prefix(u, F.lit("/recalls/")))

_FRAGMENTS = """f AS (SELECT source, url, detail, probable, unnest(list_distinct(list_filter([CASE WHEN parts[1] LIKE '\\_\\_\\_%' ESCAPE '\\' THEN '/' || parts[1] || '/' END,
  CASE WHEN parts[1] LIKE '\\_\\_\\_%' ESCAPE '\\' AND len(parts) >= 2 THEN p2 END, CASE WHEN parts[1] LIKE '\\_\\_\\_%' ESCAPE '\\' AND len(parts) >= 2 THEN '/' || parts[2] || '/' END,
  p2, p1], lambda x: x IS NOT NULL))) AS fragment FROM shape)"""


@query("ur13_fragments", f"WITH {_SHAPES}, {_FRAGMENTS} SELECT source, fragment, count(*) AS n FROM f GROUP BY ALL")
def _(s, d):
    found = source_links(s, d).select("source", F.explode(pages.fragments(urls.path_parts(F.col("url")))).alias("fragment"))
    return found.groupBy("source", "fragment").agg(F.count("*").alias("n"))


@query("ur15_normalized_fragments", "WITH x AS (SELECT DISTINCT source_url, web_source FROM alerts), v AS (SELECT source_url, web_source, list_transform(list_filter(list_transform([source_url, web_source, ' '], lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^https?://') THEN regexp_extract(x, '^[a-z]+://[^/?#]*([^?#]*)', 1) ELSE x END) AS l FROM x) SELECT source_url, array_to_string(list_filter(list_transform(l, lambda x: CASE WHEN x LIKE '/%' THEN x ELSE '/' || x END), lambda x: length(x) >= 2), ' ') AS fragments FROM v")
def _(s, d):
    x = table(s, d, "alerts").select("source_url", "web_source").distinct()
    return x.select("source_url", F.array_join(pages.normalized_fragments(F.array("source_url", "web_source", F.lit(" "))), " ").alias("fragments"))


def listing_scored(s, d):
    return links.hub_points(source_links(s, d)).withColumn("score", pages.listing_score(F.col("url"), F.col("hub")))


def notice_scored(s, d):
    return links.cluster_points(source_links(s, d)).withColumn("score", pages.detail_score(F.col("url"), F.col("cluster")))


@query("pr01_listing_score", f"WITH {_SCORES} SELECT source, url, score FROM scored")
def _(s, d):
    return listing_scored(s, d).select("source", "url", F.col("score").cast("bigint").alias("score"))


@query("pr02_detail_score", f"WITH {_SCORES} SELECT source, url, notice AS score FROM scored")
def _(s, d):
    return notice_scored(s, d).select("source", "url", F.col("score").cast("bigint").alias("score"))


@query("jn19_hub_points", f"WITH {_SCORES} SELECT source, url, hub FROM scored WHERE hub > 0")
def _(s, d):
    return links.hub_points(source_links(s, d)).filter("hub > 0").select("source", "url", F.col("hub").cast("bigint").alias("hub"))


@query("jn20_cluster_points", f"WITH {_SCORES} SELECT source, url, cluster FROM scored WHERE cluster > 0")
def _(s, d):
    return links.cluster_points(source_links(s, d)).filter("cluster > 0").select("source", "url", F.col("cluster").cast("bigint").alias("cluster"))


@query("ag11_listing_density", f"WITH {_SHAPES}, p AS (SELECT source, unnest([p1, p2]) AS p FROM shape) SELECT source, max(n)::bigint AS density FROM (SELECT source, p, count(*) AS n FROM p WHERE p IS NOT NULL AND NOT regexp_matches(p, '{pages.ASSET_PATTERN}') GROUP BY ALL) GROUP BY source")
def _(s, d):
    parts = urls.path_parts(F.col("url"))
    p = source_links(s, d).select("source", F.explode(F.array_compact(F.array(pages.prefix(parts, 1), pages.prefix(parts, 2)))).alias("p"))
    n = p.filter(~F.col("p").rlike(pages.ASSET_PATTERN)).groupBy("source", "p").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.max("n").alias("density"))


@query("ag12_best_per_url", f"WITH {_SCORES} SELECT source, url, greatest(score, notice) AS score FROM scored")
def _(s, d):
    both = listing_scored(s, d).select("source", "url", "score").unionByName(notice_scored(s, d).select("source", "url", "score"))
    return links.best_per_url(both).select("source", "url", F.col("score").cast("bigint").alias("score"))


_COUNTED = f"""{_SHAPES}, {_FRAGMENTS},
n AS (SELECT source, fragment, count(*) FILTER (detail) AS confirmed, count(*) FILTER (NOT detail) AS probable FROM f WHERE probable AND NOT regexp_matches(fragment, '{pages.ASSET_PATTERN}') GROUP BY ALL),
sure AS (SELECT source, fragment, confirmed AS n, row_number() OVER (PARTITION BY source ORDER BY confirmed DESC, fragment) AS rank FROM (SELECT *, max(confirmed) OVER (PARTITION BY source) AS top FROM n WHERE confirmed > 0) WHERE top < 2 OR confirmed >= 2),
likely AS (SELECT source, fragment, probable AS n, row_number() OVER (PARTITION BY source ORDER BY probable DESC, fragment) AS rank FROM (SELECT *, max(probable) OVER (PARTITION BY source) AS top FROM n WHERE probable > 0) WHERE top < 2 OR probable >= 2)"""


@query("ag14_ranked_fragments", f"WITH {_COUNTED} SELECT source, fragment, n, rank FROM sure")
def _(s, d):
    found = links.ranked_fragments(links.fragment_counts(source_links(s, d)), "confirmed")
    return found.select("source", "fragment", "n", F.col("rank").cast("bigint").alias("rank"))


@query("ag13_inferred_keywords", f"""WITH {_COUNTED}, b AS (SELECT source, fragment, rank, 0 AS part FROM sure UNION ALL
SELECT source, fragment, rank, 1 FROM likely l WHERE NOT EXISTS (FROM sure s WHERE s.source = l.source AND s.fragment = l.fragment) AND (n >= 2 OR source NOT IN (SELECT source FROM sure)))
SELECT source, fragment, rank FROM (SELECT source, fragment, row_number() OVER (PARTITION BY source ORDER BY part, rank) AS rank FROM b) WHERE rank <= 5""")
def _(s, d):
    return links.inferred_keywords(source_links(s, d)).select("source", "fragment", F.col("rank").cast("bigint").alias("rank"))


@query("so04_ranked_links", f"WITH {_SCORES} SELECT source, rank, url, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, url) AS rank FROM scored) WHERE rank <= {MOST_CANDIDATES}")
def _(s, d):
    found = links.first_of_source(listing_scored(s, d), MOST_CANDIDATES)
    return found.select("source", F.col("rank").cast("bigint").alias("rank"), "url", F.col("score").cast("bigint").alias("score"))


@query("so05_ranked_notices", f"WITH {_SCORES} SELECT source, rank, url, notice AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY notice DESC, url) AS rank FROM scored) WHERE rank <= {MOST_CHILDREN}")
def _(s, d):
    found = links.first_of_source(notice_scored(s, d), MOST_CHILDREN)
    return found.select("source", F.col("rank").cast("bigint").alias("rank"), "url", F.col("score").cast("bigint").alias("score"))


@query("so06_seeds", f"""WITH {_SCORES}, r AS (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY score DESC, url) AS rank FROM scored WHERE listing AND score > 0)
SELECT s.source_name AS source, coalesce(r.url, s.homepage_url) AS url FROM (SELECT DISTINCT source_name, homepage_url FROM sources) s LEFT JOIN r ON r.source = s.source_name AND r.rank <= {MOST_SEEDS}""")
def _(s, d):
    good = listing_scored(s, d).filter(pages.listing(F.col("url")) & (F.col("score") > 0))
    seeds = links.first_of_source(good, MOST_SEEDS).select("source", "url")
    named = t.sources(s, d).select(F.col("source_name").alias("source"), "homepage_url")
    return named.join(seeds, "source", "left").select("source", F.coalesce("url", "homepage_url").alias("url"))


@query("se06_unfiltered", f"WITH {_SHAPES}, x AS (SELECT source, url, regexp_replace(url, '[?#].*$', '') AS bare FROM shape) SELECT DISTINCT x.source, CASE WHEN contains(x.url, '?') AND o.listing THEN x.bare ELSE x.url END AS url FROM x LEFT JOIN (SELECT DISTINCT source, lower(url) AS u, listing FROM shape WHERE listing) o ON o.source = x.source AND o.u = lower(x.bare)")
def _(s, d):
    x = source_links(s, d).withColumn("bare", F.regexp_replace("url", r"[?#].*$", ""))
    seen = source_links(s, d).filter(pages.listing(F.col("url"))).select("source", F.lower("url").alias("u")).distinct()
    seen = seen.withColumn("held", F.lit(True)).withColumnRenamed("source", "of")
    met = x.join(seen, (F.col("of") == F.col("source")) & (F.col("u") == F.lower("bare")), "left")
    return met.select("source", F.when(F.contains("url", F.lit("?")) & F.col("held"), F.col("bare")).otherwise(F.col("url")).alias("url")).distinct()


def _domains(s, d):
    return t.sources(s, d).select(F.col("source_name").alias("source"), "allowed_domains")


@query("fl10_source_allow_list", f"WITH {_SHAPES} SELECT x.source, x.url FROM shape x JOIN (SELECT DISTINCT source_name, allowed_domains FROM sources) s ON s.source_name = x.source WHERE len(list_filter(s.allowed_domains, lambda p: ends_with(lower(regexp_extract(x.url, '^[A-Za-z]+://([^/?#]*)', 1)), p))) > 0 AND NOT starts_with(x.path, '/alerts')")
def _(s, d):
    held = source_links(s, d).join(_domains(s, d), "source")
    inside = F.exists("allowed_domains", lambda x: F.endswith(urls.host(F.col("url")), x))
    return held.filter(inside & ~F.startswith(F.lower(urls.path(F.col("url"))), F.lit("/alerts"))).select("source", "url")


@query("fl12_allowed_list", "SELECT DISTINCT c.canonical_url AS url FROM candidates c WHERE regexp_matches(trim(c.canonical_url), '^https?://') AND EXISTS (FROM (SELECT DISTINCT unnest(allowed_domains) AS dom FROM sources) WHERE regexp_replace(lower(regexp_extract(trim(c.canonical_url), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', '') = dom)")
def _(s, d):
    listed = table(s, d, "candidates").select(F.trim("canonical_url").alias("url")).filter(F.col("url").rlike("^https?://")).distinct()
    domains = t.sources(s, d).select(F.explode("allowed_domains").alias("domain")).distinct()
    bare = F.regexp_replace(F.regexp_replace(urls.host(F.col("url")), ":.*$", ""), r"^www\.", "")
    return listed.join(domains, bare == F.col("domain"), "left_semi").select("url")


_SEEDS = f"seeds AS (SELECT source, url FROM (SELECT source, url, path, row_number() OVER (PARTITION BY source ORDER BY score DESC, url) AS rank FROM scored WHERE listing AND score > 0) WHERE rank <= {MOST_SEEDS})"


@query("fl13_detail_keywords", f"""WITH {_SCORES}, {_SEEDS}, {_FRAGMENTS}, k AS (SELECT DISTINCT source, fragment FROM f WHERE probable)
SELECT k.source, k.fragment FROM k WHERE NOT EXISTS (FROM seeds WHERE seeds.source = k.source AND contains(lower(seeds.url), rtrim(k.fragment, '/')))
AND EXISTS (FROM scored c WHERE c.source = k.source AND contains(lower(c.url), k.fragment))""")
def _(s, d):
    found = source_links(s, d)
    k = found.filter(pages.probable_detail(F.col("url"))).select("source", F.explode(pages.fragments(urls.path_parts(F.col("url")))).alias("fragment")).distinct()
    good = listing_scored(s, d).filter(pages.listing(F.col("url")) & (F.col("score") > 0))
    # At most three seeds for each source.
    seeds = links.first_of_source(good, MOST_SEEDS).groupBy("source").agg(F.collect_list(F.lower("url")).alias("seeds"))
    bare = F.regexp_replace("fragment", "/+$", "")
    free = k.join(seeds, "source", "left").filter(~F.coalesce(F.exists("seeds", lambda x: F.contains(x, bare)), F.lit(False)))
    # Every run of one or two whole segments of an address; a keyword must stand in one of the links.
    pieces = F.split(F.lower("url"), "/")
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    ones = F.transform(inner, lambda x: F.concat(F.lit("/"), x, F.lit("/")))
    twos = F.zip_with(ones, F.slice(inner, 2, 1000), lambda a, b: F.concat(a, b, F.lit("/")))
    held = found.select("source", F.explode(F.concat(ones, F.array_compact(twos))).alias("fragment"))
    return free.join(held, ["source", "fragment"], "left_semi").select("source", "fragment")


@query("fl14_blocked_paths", f"WITH {_SCORES}, {_SEEDS}, {_FRAGMENTS}, b AS (SELECT DISTINCT source, fragment FROM f) SELECT b.source, b.fragment FROM b WHERE NOT EXISTS (FROM seeds WHERE seeds.source = b.source AND starts_with(lower(regexp_extract(seeds.url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), b.fragment))")
def _(s, d):
    found = source_links(s, d)
    b = found.select("source", F.explode(pages.fragments(urls.path_parts(F.col("url")))).alias("fragment")).distinct()
    good = listing_scored(s, d).filter(pages.listing(F.col("url")) & (F.col("score") > 0))
    seeds = links.first_of_source(good, MOST_SEEDS).groupBy("source").agg(F.collect_list(F.lower(urls.path(F.col("url")))).alias("paths"))
    covered = F.exists("paths", lambda p: F.startswith(p, F.col("fragment")))
    return b.join(seeds, "source", "left").filter(~F.coalesce(covered, F.lit(False))).select("source", "fragment")
