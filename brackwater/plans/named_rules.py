"""Queries of rules that other queries use inside, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from brackwater.functions import ids, text, urls
from brackwater.operators import links, pages_html, payloads, searches, upsert
from brackwater.plans import crawl, fetched, incidents, linking
from brackwater.plans import payloads as records
from brackwater.plans.serving import A, I
from brackwater.runtime import table
from brackwater.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_FOLDED = "array_to_string(regexp_extract_all(replace(lower(strip_accents(replace(coalesce({}, ''), '&', ' and '))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'), ' ')"


@query("tx01_folded", f"WITH {I} SELECT incident_id, {_FOLDED.format('company_name')} AS company FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", text.folded(F.col("company_name")).alias("company"))


@query("tx08_clean_payloads", "SELECT DISTINCT field_recall_number, NOT regexp_matches(coalesce(field_press_release, ''), '<[^>]+>') AS was_clean, true AS is_clean FROM us_recall WHERE field_recall_number IS NOT NULL")
def _(s, d):
    """Texts before and after cleaning: none may hold a tag afterwards."""
    u = table(s, d, "us_recall").filter("field_recall_number IS NOT NULL").select("field_recall_number", F.coalesce("field_press_release", F.lit("")).alias("x")).distinct()
    tag = "<[^>]+>"
    return u.select("field_recall_number", (~F.col("x").rlike(tag)).alias("was_clean"), (~text.strip_markup(F.col("x")).rlike(tag)).alias("is_clean"))


@query("wn01_interleaved", f"WITH {linking._CATALOGUE} SELECT country, row_number() OVER (PARTITION BY country ORDER BY pos)::int AS turn, text FROM catalogue")
def _(s, d):
    turn = F.row_number().over(Window.partitionBy("country").orderBy("pos"))
    return searches.catalogue(s).select("country", turn.alias("turn"), "text")


@query("wn04_first_per_url", "SELECT source_url, arg_min(alert_id, alert_id) AS alert_id, arg_min(product_name, alert_id) AS product_name FROM alerts WHERE load_no = 1 AND source_url IS NOT NULL GROUP BY 1")
def _(s, d):
    batch = table(s, d, "alerts").filter("load_no = 1 AND source_url IS NOT NULL").select("source_url", "alert_id", "product_name")
    return upsert.first_per_key(batch, ["source_url"], ["alert_id"])


@query("wn05_latest_kept", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(s, d):
    return upsert.retain_newest(t.events(s, d).select("ts", "event_id"), ["ts", "event_id"], 500).select("event_id")


@query("sk07_pruned", "SELECT count(*) - 5000 AS pruned FROM events")
def _(s, d):
    """Events that retention removes from the log."""
    return t.events(s, d).agg((F.count("*") - 5000).alias("pruned"))


@query("so03_top_countries", f"WITH {A} SELECT country_source AS value, count(*) AS n FROM a WHERE country_source IS NOT NULL GROUP BY 1 ORDER BY n DESC, max(recall_date) DESC NULLS LAST, value LIMIT 5")
def _(s, d):
    g = t.alerts(s, d, "country_source IS NOT NULL").groupBy(F.col("country_source").alias("value")).agg(F.count("*").alias("n"), F.max("recall_date").alias("newest"))
    return g.orderBy(F.desc("n"), F.desc_nulls_last("newest"), "value").limit(5).select("value", "n")


@query("so09_nearest_three", linking.ORACLES["jn14_nearest"].replace("<= 10", "<= 3"))
def _(s, d):
    return linking.semantic.nearest(table(s, d, "embeddings").filter("vec_id % 20 = 0"), table(s, d, "embeddings"), 3)


@query("se02_united_groups", f"WITH {crawl._SCORES} SELECT source, url, max(s)::bigint AS score FROM (SELECT source, url, score AS s FROM scored WHERE listing UNION ALL SELECT source, url, notice FROM scored WHERE probable) GROUP BY ALL")
def _(s, d):
    listed = crawl.listing_scored(s, d).filter(crawl.pages.listing(F.col("url"))).select("source", "url", "score")
    noticed = crawl.notice_scored(s, d).filter(crawl.pages.probable_detail(F.col("url"))).select("source", "url", "score")
    return links.best_per_url(listed.unionByName(noticed)).select("source", "url", F.col("score").cast("bigint").alias("score"))


@query("se03_shared_keys", f"WITH {I} SELECT incident_id, len(list_intersect(list_transform(coalesce(evidence, []), lambda e: lower(trim(e.url))), list_transform(coalesce(evidence, []), lambda e: lower(trim(e.url)))))::int AS urls, len(list_intersect(list_transform(coalesce(evidence, []), lambda e: lower(trim(e.url))), [lower(trim(primary_source_url))]))::int AS own FROM i")
def _(s, d):
    each = F.coalesce(F.transform("evidence.url", lambda u: F.lower(F.trim(u))), F.array().cast("array<string>"))
    known = F.array_compact(each)
    return t.incidents(s, d).select("incident_id", F.size(F.array_intersect(known, known)).alias("urls"), F.size(F.array_intersect(known, F.array_compact(F.array(F.lower(F.trim("primary_source_url")))))).alias("own"))


@query("fl11_source_keywords", f"WITH {crawl._COUNTED}, k AS (SELECT source, fragment FROM sure WHERE rank <= 5) SELECT DISTINCT s.source, s.url FROM shape s JOIN k ON k.source = s.source AND contains(lower(s.url), k.fragment)")
def _(s, d):
    """Links that hold one of the (at most five) confirmed keywords of their source, anywhere in the address."""
    found = crawl.source_links(s, d)
    k = links.ranked_fragments(links.fragment_counts(found), "confirmed").filter("rank <= 5").groupBy("source").agg(F.collect_list("fragment").alias("words"))
    return found.join(k, "source").filter(links.any_contains(F.lower("url"), F.col("words"))).select("source", "url")


def text_match(left: Column, right: Column, least: Column | int = 2) -> Column:
    """Two folded names are equal, or the words of the one with fewer are all among the other's and number ``least``."""
    a, b = F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " "))
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (left != "") & (right != "") & ((left == right) | (inside & (F.least(F.size(a), F.size(b)) >= least)))


_MATCH = "({0} <> '' AND {1} <> '' AND ({0} = {1} OR (least(len(list_distinct(string_split({0}, ' '))), len(list_distinct(string_split({1}, ' ')))) >= {2} AND (list_has_all(string_split({0}, ' '), string_split({1}, ' ')) OR list_has_all(string_split({1}, ' '), string_split({0}, ' '))))))"


@query("jn06_entity_overlap", f"""WITH {I}, n AS (SELECT incident_id, lower(trim(incident_id)) AS k, {_FOLDED.format('product_name')} AS p, {_FOLDED.format('company_name')} AS c, {_FOLDED.format('hazard_type')} AS h FROM i),
m AS (SELECT DISTINCT lower(trim(incident_id, e' \\t\\n\\r')) AS a, lower(trim(matched_id, e' \\t\\n\\r')) AS b FROM match_results),
x AS (SELECT l.incident_id AS id, r.incident_id AS other_id, {_MATCH.format('l.p', 'r.p', 2)} AS p, {_MATCH.format('l.c', 'r.c', 2)} AS c2, {_MATCH.format('l.c', 'r.c', 1)} AS c1, {_MATCH.format('l.h', 'r.h', 2)} AS h FROM m JOIN n l ON l.k = m.a JOIN n r ON r.k = m.b WHERE m.a <> m.b)
SELECT id, other_id, concat_ws(',', CASE WHEN p THEN 'product' END, CASE WHEN c2 OR (p AND c1) THEN 'company' END, CASE WHEN h THEN 'hazard' END) AS overlap FROM x""")
def _(s, d):
    """What the two incidents of each stated match have in common; a company's single word counts beside a matching product."""
    names = t.incidents(s, d).select("incident_id", F.lower(F.trim("incident_id")).alias("k"), *(text.folded(F.col(c)).alias(n) for c, n in (("product_name", "p"), ("company_name", "c"), ("hazard_type", "h"))))
    side = lambda e: names.select(*(F.col(c).alias(f"{e}_{c}") for c in names.columns))
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    m = table(s, d, "match_results").select(tidy("incident_id").alias("l_k"), tidy("matched_id").alias("r_k")).filter("l_k <> r_k").distinct()
    x = m.join(side("l"), "l_k").join(side("r"), "r_k")
    product = text_match(F.col("l_p"), F.col("r_p"))
    company = text_match(F.col("l_c"), F.col("r_c"), F.when(product, 1).otherwise(2))
    found = F.array_compact(F.array(F.when(product, "product"), F.when(company, "company"), F.when(text_match(F.col("l_h"), F.col("r_h")), "hazard")))
    return x.select(F.col("l_incident_id").alias("id"), F.col("r_incident_id").alias("other_id"), F.array_join(found, ",").alias("overlap"))


_ALIASES = ", ".join(f"({i}, {linking._text(c)}, {linking._text(a)})" for i, (c, n, more, _g, _d) in enumerate(searches.COUNTRIES) for a in (n, *more))
_PLACE = "trim(regexp_replace(lower(strip_accents(replace(coalesce({}, ''), '&', ' '))), '[^a-z0-9]+', ' ', 'g'))"


@query("jn12_target_country", f"WITH {I}, al(pos, code, alias) AS (VALUES {_ALIASES}), p AS (SELECT incident_id, {_PLACE.format('country')} AS place FROM i), q AS (SELECT pos, code, {_PLACE.format('alias')} AS alias FROM al) SELECT incident_id, arg_min(code, pos) AS code FROM p JOIN q ON place = alias OR (length(alias) > 3 AND contains(' ' || place || ' ', ' ' || alias || ' ')) GROUP BY 1")
def _(s, d):
    """The first configured country whose name or alias the incident's place is, or holds as whole words."""
    rows = [(i, c, a) for i, (c, n, more, _g, _d) in enumerate(searches.COUNTRIES) for a in (n, *more)]
    al = s.createDataFrame(rows, "pos int, code string, a string").select("pos", "code", text.place(F.col("a")).alias("alias"))
    p = t.incidents(s, d).select("incident_id", text.place(F.col("country")).alias("place"))
    # The aliases are configuration: some dozens of rows.
    hit = (F.col("place") == F.col("alias")) | ((F.length("alias") > 3) & F.contains(F.concat(F.lit(" "), "place", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" "))))
    return p.join(F.broadcast(al), hit).groupBy("incident_id").agg(F.min_by("code", "pos").alias("code"))


@query("jn17_registry_country", f"WITH {A} SELECT DISTINCT a.web_source, coalesce(min(s.country_source) OVER (PARTITION BY a.web_source), 'unknown') AS country FROM a LEFT JOIN sources s ON s.source_name = a.web_source WHERE a.web_source IS NOT NULL")
def _(s, d):
    named = t.sources(s, d).select(F.col("source_name").alias("web_source"), "country_source")
    used = table(s, d, "alerts").select("web_source").filter("web_source IS NOT NULL").distinct()
    return used.join(named, "web_source", "left").select("web_source", F.coalesce("country_source", F.lit("unknown")).alias("country"))


@query("js07_repaired", records.ORACLES["js08_fallback_records"].replace("SELECT k.rec_id, coalesce(name, '') AS product_name", "SELECT k.rec_id, 'uk' AS web_source, coalesce(name, '') AS product_name").replace(", 'Unknown' AS hazard_type, 'Other' AS product_category", ""))
def _(s, d):
    """The deterministic fields laid over a structured record: source, name and address of the original."""
    made = records.QUERIES["js08_fallback_records"](s, d)
    return made.select("rec_id", F.lit("uk").alias("web_source"), "product_name", "source_url")


@query("js09_json_safe", "SELECT event_id, '{\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"value\":' || CASE WHEN value IS NULL THEN 'null' ELSE round(value * 100)::bigint::varchar END || '}' AS document FROM events")
def _(s, d):
    e = t.events(s, d).select("event_id", F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.round(F.col("value") * 100).cast("bigint").alias("value")).alias("x"))
    return e.select("event_id", F.to_json("x", {"ignoreNullFields": "false"}).alias("document"))


@query("js10_envelopes", "SELECT DISTINCT notation, md5('{\"source\":\"uk\",\"payload\":' || payload || '}') AS envelope FROM uk_recall WHERE payload IS NOT NULL")
def _(s, d):
    u = table(s, d, "uk_recall").select("notation", "payload").filter("payload IS NOT NULL").distinct()
    return u.select("notation", F.md5(F.concat(F.lit('{"source":"uk","payload":'), "payload", F.lit("}"))).alias("envelope"))


@query("st07_prepared")
def _(s, d):
    """Fingerprint, id derived from it, and confidence of each incident before it is matched."""
    made = incidents.QUERIES["hs03_cluster_fingerprint"](s, d).join(incidents.QUERIES["pr05_incident_confidence"](s, d), "incident_id")
    return made.select("incident_id", "fingerprint", ids.uuid5(F.col("fingerprint"), linking.INCIDENT_NAMESPACE).alias("derived_id"), "score")


@query("st01_resolution")
def _(s, d):
    """What saving an incident does: merge into the one it matches if that was seen before, else insert."""
    seen = t.incidents(s, d).select("incident_id", "first_discovered_at")
    match = incidents.QUERIES["jn01_best_match"](s, d)
    other = seen.select(F.col("incident_id").alias("other_id"), F.col("first_discovered_at").alias("other_seen"))
    met = seen.join(match, seen["incident_id"] == match["id"], "left").join(other, "other_id", "left")
    earlier = F.coalesce(F.col("other_seen") < F.col("first_discovered_at"), F.lit(False))
    return met.select("incident_id", F.when(earlier, "merge").otherwise("insert").alias("action"), F.when(earlier, F.col("other_id")).alias("target"), F.when(earlier, F.col("kind")).alias("kind"))


@query("sc20_bounded_payloads")
def _(s, d):
    """At most two of the objects of a list, other entries passed over; a payload that is no list gives none."""
    held = payloads.bounded_items(table(s, d, "uk_recall"), "notation", "payload", "problem", 2)
    return held.groupBy("rec_id").agg(F.count("*").alias("n"))


@query("sc13_envelope_items", "SELECT alert_id, f.feed, alert_id AS item FROM (SELECT DISTINCT alert_id FROM alerts), (VALUES ('items'), ('list'), ('results')) f(feed)")
def _(s, d):
    """The three envelopes in which feeds are delivered, here each around every alert."""
    one = table(s, d, "alerts").select("alert_id").distinct().select("alert_id", F.to_json(F.array(F.struct("alert_id"))).alias("l"))
    forms = F.create_map(F.lit("list"), "l", F.lit("results"), F.concat(F.lit('{"results":'), "l", F.lit("}")), F.lit("items"), F.concat(F.lit('{"items":'), "l", F.lit("}")))
    feeds = one.select("alert_id", F.explode(forms).alias("feed", "body")).select(F.concat_ws("|", "alert_id", "feed").alias("id"), "body")
    found = payloads.envelope_items(feeds, "id", "body")
    part = F.split("rec_id", r"\|")
    return found.select(F.get(part, F.lit(0)).alias("alert_id"), F.get(part, F.lit(1)).alias("feed"), F.get_json_object("item", "$.alert_id").alias("item"))


@query("jn15_semantic_decisions", "WITH s AS (SELECT q.vec_id AS query_id, x.vec_id, q.label = x.label AS same, list_cosine_similarity(q.embedding::double[], x.embedding::double[]) AS score FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), m AS (SELECT query_id, arg_min(vec_id, rank) AS vec_id, arg_min(score, rank) AS score FROM r WHERE rank <= 10 AND same AND score >= 0.3 GROUP BY 1) SELECT query_id, vec_id, CASE WHEN score >= 0.4 THEN 'merge' ELSE 'review' END AS decision FROM m")
def _(s, d):
    """The first near enough neighbour of the same kind; the label stands for the shared entity, and the thresholds fit these vectors."""
    e = table(s, d, "embeddings")
    near = linking.semantic.nearest(e.filter("vec_id % 20 = 0"), e, 10, scores=True)
    return linking.semantic.merge_decisions(near, e, 0.3, 0.4)


@query("so07_frontier", f"WITH {crawl._SCORES}, x AS (SELECT source, url, CASE WHEN contains(lower(url), 'recall') THEN 12 ELSE 0 END - CASE WHEN regexp_matches(lower(url), 'faq|support|privacy|contact|mentions-legales') THEN 4 ELSE 0 END AS points, len(parts) AS depth FROM scored) SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY points DESC, depth, url)::int AS place FROM x")
def _(s, d):
    """The order in which a crawl takes a source's links: points, then depth, then address."""
    u = F.col("url")
    x = crawl.source_links(s, d).withColumn("points", pages_html.crawl_points(u, F.array(F.lit("recall")))).withColumn("depth", F.size(urls.path_parts(u)))
    return x.select("source", "url", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("points"), "depth", "url")).alias("place"))


@query("ht02_content_root", f"WITH {fetched._U} SELECT url, false AS holds_menu FROM u")
def _(s, d):
    """The text comes from the main part: the menu beside it is not in it."""
    return fetched.facts(s, d).select("url", F.contains("text", F.lit("All recalls")).alias("holds_menu"))


@query("ht04_linked_dates", "SELECT DISTINCT field_recall_number AS url, trim(field_recall_date) AS date_value FROM us_recall WHERE field_recall_number IS NOT NULL AND trim(coalesce(field_recall_date, '')) <> ''")
def _(s, d):
    """Dates of a nested JSON-LD block."""
    u = table(s, d, "us_recall").filter("field_recall_number IS NOT NULL").select("field_recall_number", F.coalesce("field_recall_date", F.lit("")).alias("d")).distinct()
    block = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("d").alias("datePublished")).alias("about"))).alias("@graph")))
    page = u.select("field_recall_number", F.concat(F.lit('<html><head><script type="application/LD+JSON">'), block, F.lit("</script></head></html>")).alias("html"))
    return pages_html.page_facts(page, "field_recall_number", "html").select("url", F.explode("date_values").alias("date_value"))


@query("st11_change_notices", "SELECT load_no, count(DISTINCT source_url) AS changed FROM alerts WHERE load_no > 0 AND source_url IS NOT NULL GROUP BY 1")
def _(s, d):
    """How many keys each load changed; a load without changes tells nobody."""
    a = table(s, d, "alerts").filter("load_no > 0 AND source_url IS NOT NULL")
    return a.groupBy("load_no").agg(F.countDistinct("source_url").alias("changed")).filter("changed > 0")


@query("sk14_event_frames", "SELECT load_no, 'event: alerts-changed' || chr(10) || 'data: {\"count\": ' || count(DISTINCT source_url) || '}' || chr(10) || chr(10) AS frame FROM alerts WHERE load_no > 0 AND source_url IS NOT NULL GROUP BY 1")
def _(s, d):
    changed = QUERIES["st11_change_notices"](s, d)
    return changed.select("load_no", F.concat(F.lit('event: alerts-changed\ndata: {"count": '), "changed", F.lit("}\n\n")).alias("frame"))


@query("st12_keepalives", "WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT user_id, sum(gap // 30000000)::bigint AS keepalives FROM g WHERE gap IS NOT NULL GROUP BY 1")
def _(s, d):
    """A sign of life for each 30 seconds without an event."""
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = t.events(s, d).select("user_id", gap.alias("gap")).filter("gap IS NOT NULL")
    return g.groupBy("user_id").agg(F.sum(F.expr("gap div 30000000")).alias("keepalives"))


@query("st15_daily_runs", "SELECT DISTINCT strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS run_day FROM events")
def _(s, d):
    """The daily run at three o'clock to which each event belongs."""
    return t.events(s, d).select(F.date_format(F.col("ts") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd").alias("run_day")).distinct()
