"""Queries on fetched pages.  The pages are built from the US feed: its title, dates and press release in a page's frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackwater.functions import urls
from brackwater.operators import pages_html as ph
from brackwater.runtime import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_U = "u AS (SELECT DISTINCT field_recall_number AS id, 'https://feed.test/recalls/' || field_recall_number AS url, coalesce(field_title, '') AS title, coalesce(field_recall_date, '') AS d, coalesce(field_recall_url, '') AS link, coalesce(field_press_release, '') AS body FROM us_recall WHERE field_recall_number IS NOT NULL)"


def fetched(s, d):
    """(url, html) of one page for each US recall."""
    u = table(s, d, "us_recall").filter("field_recall_number IS NOT NULL").select(
        "field_recall_number", *(F.coalesce(c, F.lit("")).alias(c) for c in ("field_title", "field_recall_date", "field_recall_url", "field_press_release"))
    ).distinct()
    html = F.concat(
        F.lit('<!doctype html><html lang="en-US"><head><title> '), "field_title", F.lit(' </title><meta name="Date" content="'), "field_recall_date",
        F.lit('"></head><body><nav><a href="/recalls">All recalls</a><a href="mailto:x@y">Mail</a><a href="?page=2#top">Next</a></nav><main><h1>'), "field_title",
        F.lit('</h1><a href="'), "field_recall_url", F.lit('">This <b>notice</b></a><p>'), "field_press_release", F.lit("</p></main><script>ignored()</script></body></html>"),
    )
    return u.select(F.concat(F.lit("https://feed.test/recalls/"), "field_recall_number").alias("url"), html.alias("html"))


def facts(s, d):
    return ph.page_facts(fetched(s, d), "url", "html")


@query("tx15_page_titles", f"WITH {_U} SELECT url, coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), url) AS title FROM u")
def _(s, d):
    return facts(s, d).select("url", "title")


@query("ht05_page_languages", f"WITH {_U} SELECT url, 'en-US' AS lang FROM u")
def _(s, d):
    return facts(s, d).select("url", "lang")


@query("ht03_structured_dates", f"WITH {_U} SELECT url, d AS date_value FROM u WHERE d <> ''")
def _(s, d):
    return facts(s, d).select("url", F.explode("date_values").alias("date_value"))


@query("ht06_internal_links", f"WITH {_U} SELECT url, 'https://feed.test/recalls' AS link FROM u UNION ALL SELECT url, url || '?page=2' FROM u")
def _(s, d):
    """Links of the page's own site."""
    each = facts(s, d).select("url", F.explode("links").alias("l")).select("url", F.col("l.url").alias("link"))
    return each.filter(F.endswith(urls.host(F.col("link")), F.lit("feed.test")))


@query("ht07_link_texts", f"WITH {_U} SELECT url, 'This notice' AS link_text, count(*) AS n FROM u WHERE starts_with(link, 'http') GROUP BY ALL")
def _(s, d):
    each = facts(s, d).select("url", F.explode("links").alias("l")).select("url", F.col("l.text").alias("link_text"), F.col("l.url").alias("link"))
    return each.filter(~F.endswith(urls.host(F.col("link")), F.lit("feed.test"))).groupBy("url", "link_text").agg(F.count("*").alias("n"))


@query("ht01_detail")
def _(s, d):
    """Headings, visible text of the main part, dates and language of each page."""
    return facts(s, d).select("url", F.array_join("headings", "").alias("headings"), F.md5("text").alias("text"), F.size("date_values").alias("dates"), "lang")


@query("ht08_page_class", f"WITH {_U} SELECT url, 'detail' AS kind FROM u")
def _(s, d):
    return facts(s, d).select("url", ph.page_class(F.col("url"), urls.path(F.col("url")), F.col("anchors"), F.array(F.lit("/recalls/"))).alias("kind"))


_DOMAIN = "SELECT DISTINCT source_url AS url, lower(regexp_replace(regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS p FROM alerts WHERE source_url IS NOT NULL"


@query("ht09_index_paths", f"WITH x AS ({_DOMAIN}) SELECT url, p = '' OR regexp_matches(p, '_node([.]html)?$') OR string_split(p, '/')[-1] IN ('', 'index', 'index.html', 'home', 'home.html', 'list', 'listing', 'search', 'results') OR (len(list_filter(string_split(p, '/'), lambda x: x <> '')) <= 3 AND NOT regexp_matches(p, '[0-9]{{4,}}') AND regexp_matches(p, '{'|'.join(ph.SECTION_WORDS)}')) AS found FROM x")
def _(s, d):
    u = table(s, d, "alerts").filter("source_url IS NOT NULL").select(F.col("source_url").alias("url")).distinct()
    return u.select("url", ph.index_path(urls.path(F.col("url"))).alias("found"))


@query("ht10_dynamic_pages", f"WITH {_U} SELECT url, false AS dynamic FROM u")
def _(s, d):
    pages = fetched(s, d)
    return ph.page_facts(pages, "url", "html").join(pages, "url").select("url", ph.drawn_by_scripts(F.col("scripts"), F.col("html")).alias("dynamic")).distinct()


@query("ht11_needs_browser", f"WITH {_U} SELECT url, CASE WHEN starts_with(link, 'http') OR link <> '' THEN 11 ELSE 11 END + length(trim(title)) < 40 AND trim(body) = '' AS shell FROM u WHERE trim(body) = ''")
def _(s, d):
    """Pages without a press release say too little in their main part; here those alone are judged."""
    pages = fetched(s, d)
    judged = ph.page_facts(pages, "url", "html").join(pages, "url").select("url", ph.needs_browser(F.col("html"), F.col("text"), 40).alias("shell"))
    bare = table(s, d, "us_recall").filter("trim(coalesce(field_press_release, '')) = ''").select(F.concat(F.lit("https://feed.test/recalls/"), "field_recall_number").alias("url")).distinct()
    return judged.join(bare, "url", "left_semi").distinct()


@query("ht12_listings", f"WITH {_U} SELECT url FROM u WHERE starts_with(link, 'http')")
def _(s, d):
    found = facts(s, d)
    return found.filter(ph.is_listing(F.col("title"), urls.path(F.col("url")), F.size("links"))).select("url")


@query("jn18_detail_links", f"WITH {_U} SELECT url, count(*) AS links FROM u GROUP BY url")
def _(s, d):
    """Links of the same host whose address names recalls, at most fifty a page, without the page's own address."""
    each = facts(s, d).select("url", F.posexplode("links").alias("i", "l")).select("url", "i", F.col("l.url").alias("link"))
    same = (urls.host(F.col("url")) == urls.host(F.col("link"))) & F.contains(F.lower("link"), F.lit("/recalls")) & ~F.contains("link", F.lit("?"))
    return each.filter(same).filter("i < 50").groupBy("url").agg(F.count("*").alias("links"))


@query("pr03_crawl_points", "WITH x AS (SELECT DISTINCT source_url AS url FROM alerts WHERE source_url IS NOT NULL) SELECT url, (CASE WHEN contains(lower(url), 'recall') OR contains(lower(url), 'notice') THEN 12 ELSE 0 END - CASE WHEN regexp_matches(lower(url), 'faq|support|privacy|contact|mentions-legales') THEN 4 ELSE 0 END)::int AS points FROM x")
def _(s, d):
    u = table(s, d, "alerts").filter("source_url IS NOT NULL").select(F.col("source_url").alias("url")).distinct()
    return u.select("url", ph.crawl_points(F.col("url"), F.array(F.lit("Recall"), F.lit("notice"))).alias("points"))


@query("pr15_browser_policy", "SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'error' AND value >= 40 AND value < 50 THEN false WHEN event_type = 'error' THEN true ELSE false END AS browser FROM events")
def _(s, d):
    """Forced: yes; an answer in the four hundreds (here an error's value from 40 to 50): no; any other error: yes."""
    e = table(s, d, "events")
    error = F.col("event_type") == "error"
    return e.select("event_id", F.when(F.col("event_type") == "click", True).when(error & (F.col("value") >= 40) & (F.col("value") < 50), False).otherwise(error).alias("browser"))
