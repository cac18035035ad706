"""Serving queries: scans, filters, search, sorts, statistics, versions, keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brackwater.functions import ids, scoring, text, urls
from brackwater.operators import upsert
from brackwater.runtime import table
from brackwater.sources import tables as t

AS_OF = "2026-03-31"
A = "a AS (SELECT DISTINCT ON (alert_id) * FROM alerts)"
I = "i AS (SELECT DISTINCT ON (incident_id) * FROM incidents)"  # noqa: E741
C = "c AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY last_seen_at DESC, attempt_count DESC) = 1)"
SEARCHED = ("product_name", "product_category", "recall_reason", "summary", "risk_level", "hazard_type", "consumer_action", "source_url", "web_source", "country_source")

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


day = lambda c: F.date_format(c, "yyyy-MM-dd")
moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
MOMENT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query("sc01_alerts_latest", f"WITH {A} SELECT alert_id, strftime(recall_date, '%Y-%m-%d') AS recall_date, risk_level FROM a ORDER BY recall_date DESC, alert_id")
def _(s, d):
    return t.alerts(s, d).select("alert_id", day("recall_date").alias("recall_date"), "risk_level").orderBy(F.desc("recall_date"), "alert_id")


@query("sc02_alert_by_id", f"WITH {A} SELECT alert_id, product_name, source_url FROM a WHERE alert_id = (SELECT min(alert_id) FROM alerts)")
def _(s, d):
    wanted = table(s, d, "alerts").agg(F.min("alert_id").alias("alert_id"))
    return t.alerts(s, d).join(F.broadcast(wanted), "alert_id", "left_semi").select("alert_id", "product_name", "source_url")


@query("sc04_known_dedupe_keys", "SELECT DISTINCT dedupe_key FROM alerts WHERE load_no > 0 AND dedupe_key IN (SELECT dedupe_key FROM alerts WHERE load_no = 0)")
def _(s, d):
    a = table(s, d, "alerts").select("dedupe_key", "load_no")
    return a.filter("load_no > 0").join(a.filter("load_no = 0"), "dedupe_key", "left_semi").select("dedupe_key").distinct()


@query("sc05_known_urls", "SELECT n.source_url, min(o.alert_id) AS stored_id, count(DISTINCT n.alert_id) AS arriving FROM (SELECT * FROM alerts WHERE load_no > 0) n JOIN (SELECT source_url, min(alert_id) AS alert_id FROM alerts WHERE load_no = 0 GROUP BY 1) o USING (source_url) GROUP BY 1")
def _(s, d):
    a = table(s, d, "alerts").select("source_url", "alert_id", "load_no")
    stored = a.filter("load_no = 0").groupBy("source_url").agg(F.min("alert_id").alias("stored_id"))
    arriving = a.filter("load_no > 0").groupBy("source_url").agg(F.countDistinct("alert_id").alias("arriving"))
    return arriving.join(stored, "source_url").select("source_url", "stored_id", "arriving")


@query("sc07_candidates_accepted", f"WITH {C} SELECT candidate_id, {MOMENT.format('last_seen_at')} AS last_seen FROM c WHERE decision = 'accept' ORDER BY last_seen_at DESC, candidate_id DESC LIMIT 50")
def _(s, d):
    c = t.candidates(s, d).filter("decision = 'accept'").orderBy(F.desc("last_seen_at"), F.desc("candidate_id")).limit(50)
    return c.select("candidate_id", moment("last_seen_at").alias("last_seen"))


@query("sc09_sources", "SELECT DISTINCT source_name, homepage_url, country_source, max_depth FROM sources ORDER BY source_name")
def _(s, d):
    return t.sources(s, d).select("source_name", "homepage_url", "country_source", "max_depth").orderBy("source_name")


@query("sc12_counts", "SELECT 'alerts' AS tbl, count(DISTINCT alert_id) AS n FROM alerts UNION ALL SELECT 'incidents', count(DISTINCT incident_id) FROM incidents UNION ALL SELECT 'candidates', count(DISTINCT candidate_id) FROM candidates")
def _(s, d):
    one = lambda n, k: table(s, d, n).agg(F.countDistinct(k).alias("n")).select(F.lit(n).alias("tbl"), "n")
    return one("alerts", "alert_id").unionByName(one("incidents", "incident_id")).unionByName(one("candidates", "candidate_id"))


@query("fl01_alert_facets", f"WITH {A} SELECT alert_id, strftime(recall_date, '%Y-%m-%d') AS recall_date FROM a WHERE risk_level = 'High' AND country_source = 'Poland'")
def _(s, d):
    a = t.alerts(s, d, (F.col("risk_level") == "High") & (F.col("country_source") == "Poland"))
    return a.select("alert_id", day("recall_date").alias("recall_date"))


@query("fl02_alert_keyword", f"WITH {A} SELECT alert_id FROM a WHERE contains(lower(array_to_string(list_filter([{', '.join(SEARCHED)}] || coalesce(affected_regions, []), lambda x: x <> ''), ' ')), 'histamine')")
def _(s, d):
    values = F.concat(F.array(*SEARCHED), F.coalesce("affected_regions", F.array().cast("array<string>")))
    joined = F.lower(F.array_join(F.filter(values, lambda x: x != ""), " "))
    return t.alerts(s, d, F.contains(joined, F.lit("histamine"))).select("alert_id")


@query("fl04_incident_filter", f"WITH {I} SELECT incident_id, confidence_score FROM i WHERE verification_status = 'pending' AND confidence_score >= 60 AND lower(country) = 'poland' AND source_kind IN ('major_news', 'blog')")
def _(s, d):
    i = t.incidents(s, d, "verification_status = 'pending' AND confidence_score >= 60 AND lower(country) = 'poland' AND source_kind IN ('major_news', 'blog')")
    return i.select("incident_id", "confidence_score")


_EFFECTIVE = r"coalesce(try_cast(regexp_extract(trim(publication_date), '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS date), CAST(first_discovered_at AS date))"


def effective_date():
    """Written publication date, else the day of the first discovery."""
    return F.expr(_EFFECTIVE)


@query("fl05_incident_search", f"WITH {I} SELECT incident_id, strftime({_EFFECTIVE}, '%Y-%m-%d') AS effective FROM i WHERE contains(lower(concat_ws(' ', coalesce(product_name, ''), coalesce(company_name, ''), coalesce(summary, ''), coalesce(incident_reason, ''))), 'dairy')")
def _(s, d):
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("product_name", "company_name", "summary", "incident_reason"))))
    return t.incidents(s, d, F.contains(joined, F.lit("dairy"))).select("incident_id", day(effective_date()).alias("effective"))


@query("fl07_effective_date", f"WITH {I} SELECT incident_id, strftime({_EFFECTIVE}, '%Y-%m-%d') AS effective FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", day(effective_date()).alias("effective"))


@query("fl08_eligible", f"WITH {C} SELECT candidate_id FROM c WHERE processing_status NOT IN ('converted', 'classified', 'unsupported_content', 'rejected') AND NOT (processing_status = 'fetch_failed' AND attempt_count >= 3) AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMPTZ '2024-06-30 00:00:00+00')")
def _(s, d):
    done = F.col("processing_status").isin("converted", "classified", "unsupported_content", "rejected")
    spent = (F.col("processing_status") == "fetch_failed") & (F.col("attempt_count") >= 3)
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.to_timestamp(F.lit("2024-06-30T00:00:00Z")))
    return t.candidates(s, d).filter(~done & ~spent & due).select("candidate_id")


#: A heading as text.header writes it, but for its length.
HEADER_SQL = "regexp_replace(trim(regexp_replace({}, '[ \\t\\n\\f\\r]+', ' ', 'g')), '^[-–—|:;\"\'\'\\s]+|[-–—|:;\"\'\'\\s]+$', '', 'g')"


@query("fl18_specific_products", f"WITH {I}, x AS (SELECT incident_id, {HEADER_SQL.format('product_name')} AS h FROM i) SELECT incident_id FROM x WHERE h <> '' AND length(h) <= 160 AND h[1:1] NOT IN ('{{', '[') AND lower(h) NOT IN ({', '.join(repr(x) for x in text.VAGUE_PRODUCTS)}) AND length(h) - length(translate(h, ',;|', '')) < 4 AND len(string_split(lower(h), ' and ')) - 1 < 4")
def _(s, d):
    return t.incidents(s, d, text.specific_product(F.col("product_name"))).select("incident_id")


@query("fl22_status_of_decision", f"WITH {C} SELECT candidate_id, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'accept' THEN 'accepted' ELSE 'discovered' END AS status FROM c")
def _(s, d):
    status = F.when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "accept", "accepted").otherwise("discovered")
    return t.candidates(s, d).select("candidate_id", status.alias("status"))


@query("ag01_totals", f"WITH {A} SELECT count(*) AS total, count(*) FILTER (recall_date >= DATE '{AS_OF}' - 7) AS last_7, count(*) FILTER (recall_date >= DATE '{AS_OF}' - 30) AS last_30 FROM a")
def _(s, d):
    since = lambda n: F.count_if(F.col("recall_date") >= F.date_sub(F.lit(AS_OF).cast("date"), n))
    return t.alerts(s, d).agg(F.count("*").alias("total"), since(7).alias("last_7"), since(30).alias("last_30"))


def _top(column: str, exploded: bool):
    value = f"unnest({column})" if exploded else column
    sql = (
        f"WITH {A}, v AS (SELECT {value} AS value, recall_date, alert_id FROM a) SELECT value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY value "
        "ORDER BY n DESC, max(recall_date) DESC NULLS LAST, value LIMIT 5"
    )

    @query(f"ag01_top_{column}", sql)
    def _(s, d):
        a = t.alerts(s, d)
        v = a.select((F.explode(column) if exploded else F.col(column)).alias("value"), "recall_date").filter("value IS NOT NULL")
        g = v.groupBy("value").agg(F.count("*").alias("n"), F.max("recall_date").alias("newest"))
        return g.orderBy(F.desc("n"), F.desc_nulls_last("newest"), "value").limit(5).select("value", "n")


for _c, _x in (("hazard_type", False), ("product_category", False), ("affected_regions", True)):
    _top(_c, _x)

STATUSES = ("pending", "corroborated", "officially_confirmed", "dismissed", "superseded")


@query("ag02_status_counts", f"WITH {I} SELECT " + ", ".join(f"count(*) FILTER (verification_status = '{x}') AS {x}" for x in STATUSES) + " FROM i")
def _(s, d):
    return t.incidents(s, d).agg(*(F.count_if(F.col("verification_status") == x).alias(x) for x in STATUSES))


@query("ag03_alerts_version", "SELECT count(*) AS n, sha256(string_agg(alert_id, ',' ORDER BY alert_id)) AS version FROM (SELECT DISTINCT alert_id FROM alerts)")
def _(s, d):
    joined = F.array_join(F.array_sort(F.collect_set("alert_id")), ",")
    return table(s, d, "alerts").agg(F.countDistinct("alert_id").alias("n"), F.sha2(joined, 256).alias("version"))


@query("ag06_latest_runs", "SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20")
def _(s, d):
    g = t.events(s, d).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max("event_id").alias("last_event"))
    return g.orderBy(F.desc("ts"), "user_id").limit(20).select("user_id", "last_event")


_INDEPENDENT = "greatest(1, len(list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: coalesce(nullif(trim(e.domain), ''), nullif(trim(e.url), ''))), lambda x: x IS NOT NULL))))"


def independent_sources():
    named = F.transform("evidence", lambda e: F.coalesce(F.nullif(F.trim(e["domain"]), F.lit("")), F.nullif(F.trim(e["url"]), F.lit(""))))
    return F.greatest(F.lit(1), F.coalesce(F.size(F.array_distinct(F.array_compact(named))), F.lit(0)))


@query("ag07_independent_sources", f"WITH {I} SELECT incident_id, {_INDEPENDENT} AS n FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", independent_sources().alias("n"))


_WEIGHT = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.BASE_WEIGHTS.items()) + " ELSE 40 END"


@query("ag08_strongest_kind", f"WITH {I}, k AS (SELECT incident_id, e.source_kind AS kind FROM (SELECT incident_id, unnest(evidence) AS e FROM i) WHERE e.source_kind IS NOT NULL) SELECT DISTINCT ON (incident_id) incident_id, kind FROM k ORDER BY incident_id, {_WEIGHT.format('kind')} DESC, kind DESC")
def _(s, d):
    kinds = t.incidents(s, d).select("incident_id", F.explode("evidence.source_kind").alias("kind")).filter("kind IS NOT NULL")
    best = kinds.groupBy("incident_id").agg(F.max(F.struct(scoring.base_weight(F.col("kind")).alias("w"), "kind")).alias("b"))
    return best.select("incident_id", F.col("b.kind").alias("kind"))


@query("ag09_mean_coordinates", f"WITH {A} SELECT country_source, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM a WHERE latitude <> 0 AND longitude <> 0 GROUP BY 1")
def _(s, d):
    a = t.alerts(s, d, "latitude <> 0 AND longitude <> 0")
    return a.groupBy("country_source").agg(F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon"))


@query("ag10_prefix_counts", f"WITH {A}, p AS (SELECT list_filter(string_split(lower(regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS p FROM a), x AS (SELECT unnest([p[1], CASE WHEN len(p) > 1 THEN p[1] || '/' || p[2] END]) AS prefix FROM p WHERE len(p) > 0) SELECT prefix, count(*) AS n FROM x WHERE prefix IS NOT NULL GROUP BY 1")
def _(s, d):
    p = t.alerts(s, d).select(urls.path_parts(F.col("source_url")).alias("p")).filter(F.size("p") > 0)
    both = F.array(F.col("p")[0], F.when(F.size("p") > 1, F.concat_ws("/", F.slice("p", 1, 2))))
    return p.select(F.explode(F.array_compact(both)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("ag20_bars", f"WITH {A}, g AS (SELECT hazard_type, count(*) AS n FROM a GROUP BY 1) SELECT hazard_type, n, round(n / max(n) OVER (), 6) AS bar FROM g")
def _(s, d):
    g = t.alerts(s, d).groupBy("hazard_type").agg(F.count("*").alias("n"))
    most = g.agg(F.max("n").alias("most"))
    return g.crossJoin(F.broadcast(most)).select("hazard_type", "n", F.round(F.col("n") / F.col("most"), 6).alias("bar"))


@query("ag21_pages", "SELECT greatest(1, ceil(count(DISTINCT alert_id) / 10))::bigint AS pages FROM alerts")
def _(s, d):
    return table(s, d, "alerts").agg(F.greatest(F.lit(1), F.ceil(F.countDistinct("alert_id") / 10)).cast("bigint").alias("pages"))


@query("so08_page_3", f"WITH {A} SELECT alert_id FROM a ORDER BY recall_date DESC NULLS LAST, alert_id LIMIT 10 OFFSET 20")
def _(s, d):
    return t.alerts(s, d).select("alert_id", "recall_date").orderBy(F.desc_nulls_last("recall_date"), "alert_id").offset(20).limit(10).select("alert_id")


@query("sk01_upsert", "WITH n AS (SELECT source_url, arg_min(struct_pack(x := alert_id, p := product_name, r := recall_date, m := summary), alert_id) AS n FROM alerts WHERE load_no > 0 GROUP BY 1), o AS (SELECT source_url, arg_min(struct_pack(x := alert_id, p := product_name, r := recall_date, m := summary), alert_id) AS o FROM alerts WHERE load_no = 0 GROUP BY 1) SELECT CASE WHEN o.o IS NULL THEN 'insert' WHEN o.o.p IS NOT DISTINCT FROM n.n.p AND o.o.r IS NOT DISTINCT FROM n.n.r AND o.o.m IS NOT DISTINCT FROM n.n.m THEN 'skip' ELSE 'update' END AS action, coalesce(o.o.x, n.n.x) AS id, source_url FROM n LEFT JOIN o USING (source_url)")
def _(s, d):
    a = table(s, d, "alerts").select("source_url", "alert_id", "product_name", "recall_date", "summary", "load_no")
    return upsert.upsert(a.filter("load_no = 0"), a.filter("load_no > 0"), "source_url", "alert_id", ["product_name", "recall_date", "summary"])


@query("sk06_retention", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def _(s, d):
    return upsert.retain_newest(t.events(s, d).select("ts", "event_id"), ["ts", "event_id"], 5000).select("event_id")


@query("st02_observations")
def _(s, d):
    m = upsert.merge_observations(table(s, d, "candidates"))
    return m.select("candidate_id", moment("first_seen_at").alias("first_seen"), moment("last_seen_at").alias("last_seen"), F.col("attempt_count").alias("attempts"), "decision", "processing_status")


@query("st05_evidence_merged", "WITH e AS (SELECT DISTINCT lower(trim(cluster_fingerprint)) AS f, trim(e.url) AS u FROM (SELECT cluster_fingerprint, unnest(evidence) AS e FROM incidents) WHERE trim(cluster_fingerprint) <> '' AND trim(e.url) <> '') SELECT f, count(*) AS n, md5(string_agg(u, ' ' ORDER BY u)) AS urls FROM e GROUP BY f")
def _(s, d):
    e = table(s, d, "incidents").select(F.lower(F.trim("cluster_fingerprint")).alias("f"), F.explode("evidence.url").alias("u")).select("f", F.trim("u").alias("u")).filter("f <> '' AND u <> ''").distinct()
    return e.groupBy("f").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("u")), " ")).alias("urls"))


@query("pr04_confidence", f"WITH {I}, x AS (SELECT incident_id, {_WEIGHT.format('source_kind')} AS base, {_INDEPENDENT} AS n, coalesce(trim(product_name), '') <> '' AS p, coalesce(trim(hazard_type), '') <> '' AS h, coalesce(trim(publication_date), '') <> '' AS w FROM i) SELECT incident_id, least(greatest(base + least((n - 1) * 5, 15) + CASE WHEN p THEN 4 ELSE 0 END + CASE WHEN h THEN 4 ELSE 0 END + CASE WHEN w THEN 2 ELSE 0 END, 0), 99)::bigint AS score FROM x")
def _(s, d):
    held = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    score, _reasons = scoring.confidence(F.col("source_kind"), independent_sources(), held("product_name"), held("hazard_type"), held("publication_date"))
    return t.incidents(s, d).select("incident_id", score.cast("bigint").alias("score"))


@query("hs01_dedupe_key", f"WITH {A} SELECT alert_id, sha256(concat_ws(chr(0), coalesce(product_name, ''), coalesce(strftime(recall_date, '%Y-%m-%d'), ''), coalesce(source_url, ''))) AS key FROM a")
def _(s, d):
    return t.alerts(s, d).select("alert_id", ids.nul_hash(F.col("product_name"), day("recall_date"), F.col("source_url")).alias("key"))


@query("wn03_run_timing", "SELECT event_id, epoch_us(ts) - epoch_us(min(ts) OVER w) AS since_start, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS since_previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    return t.events(s, d).select("event_id", (us - F.first(us).over(w)).alias("since_start"), (us - F.lag(us).over(w)).alias("since_previous"))


@query("st14_last_status", "SELECT user_id, arg_max(event_type, ts) AS status FROM events GROUP BY 1")
def _(s, d):
    return t.events(s, d).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("status"))


@query("st17_hourly_rollup", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    g = t.events(s, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


@query("st13_debounced", "WITH g AS (SELECT event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) < 300000 THEN 0 ELSE 1 END AS fresh FROM events) SELECT event_type, sum(fresh)::bigint AS refreshes, count(*) AS notices FROM g GROUP BY 1")
def _(s, d):
    """Notices that follow each other within 300 ms make one refresh."""
    g = t.events(s, d).groupBy("event_type", F.session_window("ts", "300 milliseconds")).agg(F.count("*").alias("n"))
    return g.groupBy("event_type").agg(F.count("*").alias("refreshes"), F.sum("n").alias("notices"))


@query("st13_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, k::bigint AS session_no, count(*) AS n FROM n GROUP BY ALL")
def _(s, d):
    g = t.events(s, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id").orderBy("w.start")
    return g.select("user_id", F.row_number().over(order).cast("bigint").alias("session_no"), "n")


@query("st13_backoff", f"WITH {C} SELECT candidate_id, least(power(2, greatest(attempt_count, 0)), 30)::bigint AS seconds FROM c")
def _(s, d):
    """Seconds before the next connection: doubled with each attempt, from 1 to 30."""
    return t.candidates(s, d).select("candidate_id", F.least(F.pow(F.lit(2), F.greatest("attempt_count", F.lit(0))), F.lit(30)).cast("bigint").alias("seconds"))
