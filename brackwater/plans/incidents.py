"""Queries on incidents and alerts: facets, sorts, documents, matching, merging, official links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brackwater.functions import ids, scoring, text, urls
from brackwater.operators import linkage, merge
from brackwater.plans import linking
from brackwater.plans.serving import A, AS_OF, C, HEADER_SQL, I, MOMENT, _EFFECTIVE, _WEIGHT, day, effective_date, moment
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


# --- Look-ups, facets, sorts -------------------------------------------------


@query("sc03_incident_by_id", f"WITH {I} SELECT incident_id, product_name, verification_status FROM i WHERE incident_id = (SELECT min(incident_id) FROM incidents) AND trim(incident_id) <> ''")
def _(s, d):
    wanted = table(s, d, "incidents").agg(F.min("incident_id").alias("incident_id")).filter("trim(incident_id) <> ''")
    return t.incidents(s, d).join(F.broadcast(wanted), "incident_id", "left_semi").select("incident_id", "product_name", "verification_status")


_SEARCHED = "[web_source, country_source, product_name, product_category, batch_id, recall_reason, summary, strftime(recall_date, '%Y-%m-%d'), risk_level, hazard_type, consumer_action, source_url] || coalesce(affected_regions, [])"


def searched_text(a):
    """All searchable values of an alert that are not blank, in lower case."""
    names = ("web_source", "country_source", "product_name", "product_category", "batch_id", "recall_reason", "summary")
    values = F.array(*names, day("recall_date"), "risk_level", "hazard_type", "consumer_action", "source_url")
    regions = F.coalesce("affected_regions", F.array().cast("array<string>"))
    return F.lower(F.array_join(F.filter(F.concat(values, regions), lambda x: x != ""), " "))


@query("fl03_search_values", f"WITH {A} SELECT alert_id, md5(lower(array_to_string(list_filter({_SEARCHED}, lambda x: x <> ''), ' '))) AS body FROM a")
def _(s, d):
    a = t.alerts(s, d)
    return a.select("alert_id", F.md5(searched_text(a)).alias("body"))


_DAY = "(SELECT max(recall_date) FROM alerts)"


@query("fl01_date_keyword", f"WITH {A} SELECT alert_id, strftime(recall_date, '%Y-%m-%d') AS recall_date FROM a WHERE recall_date >= {_DAY} - 60 AND risk_level IN ('High', 'Medium') AND contains(lower(array_to_string(list_filter({_SEARCHED}, lambda x: x <> ''), ' ')), 'shoppers')")
def _(s, d):
    newest = table(s, d, "alerts").agg(F.max("recall_date").alias("newest"))
    near = t.alerts(s, d, "risk_level IN ('High', 'Medium')").join(F.broadcast(newest), F.col("recall_date") >= F.date_sub("newest", 60))
    found = near.filter(F.contains(searched_text(near), F.lit("shoppers")))
    return found.select("alert_id", day("recall_date").alias("recall_date")).orderBy(F.desc("recall_date"), "alert_id")


@query("fl04_incident_type", f"WITH {I} SELECT incident_id FROM i WHERE verification_status = 'pending' AND incident_type = 'foodborne_outbreak' AND confidence_score >= 50 AND lower(trim(country)) <> ''")
def _(s, d):
    return t.incidents(s, d, "verification_status = 'pending' AND incident_type = 'foodborne_outbreak' AND confidence_score >= 50 AND lower(trim(country)) <> ''").select("incident_id")


_EIGHT = ("product_name", "company_name", "product_category", "hazard_type", "incident_reason", "summary", "country", "primary_publisher")


@query("fl05_search_by_day", f"WITH {I} SELECT incident_id FROM i WHERE contains(lower(concat_ws(' ', {', '.join(f'''coalesce({c}, '')''' for c in _EIGHT)})), 'salmonella') AND {_EFFECTIVE} >= DATE '2024-01-01'")
def _(s, d):
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in _EIGHT)))
    return t.incidents(s, d, F.contains(joined, F.lit("salmonella")) & (effective_date() >= F.lit("2024-01-01").cast("date"))).select("incident_id")


#: Sort modes of the incidents: columns and whether they fall.
SORTS = {"latest": (("e", True), ("incident_id", True)), "oldest": (("e", False), ("incident_id", False)), "confidence_high": (("confidence_score", True), ("e", True), ("incident_id", True)), "confidence_low": (("confidence_score", False), ("e", False), ("incident_id", False))}


def _sorted(mode: str, keys) -> None:
    # The place is compared within a country, so that no global window is needed for the check.
    order = ", ".join(f"{c} {'DESC NULLS LAST' if down else 'ASC NULLS LAST'}" for c, down in keys)

    @query(f"so01_{mode}_all", f"WITH {I}, x AS (SELECT incident_id, country, confidence_score, {_EFFECTIVE} AS e FROM i) SELECT incident_id, row_number() OVER (PARTITION BY country ORDER BY {order}) AS place FROM x")
    def _(s, d):
        x = t.incidents(s, d).select("incident_id", "country", "confidence_score", effective_date().alias("e"))
        columns = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]
        return x.select("incident_id", F.row_number().over(Window.partitionBy("country").orderBy(*columns)).cast("bigint").alias("place"), "country", "confidence_score", "e").orderBy(*columns).select("incident_id", "place")


for _m, _k in SORTS.items():
    _sorted(_m, _k)


@query("so02_alerts_oldest", f"WITH {A} SELECT alert_id, strftime(recall_date, '%Y-%m-%d') AS recall_date FROM a ORDER BY recall_date")
def _(s, d):
    return t.alerts(s, d).select("alert_id", day("recall_date").alias("recall_date")).orderBy("recall_date")


@query("ag04_incidents_version", f"WITH {I} SELECT count(*) AS n, sha256(string_agg(incident_id || ':' || strftime(last_discovered_at, '%Y-%m-%dT%H:%M:%S') || ':' || verification_status || ':' || confidence_score, chr(0) ORDER BY incident_id)) AS version FROM i")
def _(s, d):
    # About 100 bytes an incident in one row by definition: fit for up to some ten million incidents.
    line = F.concat_ws(":", "incident_id", F.date_format("last_discovered_at", "yyyy-MM-dd'T'HH:mm:ss"), "verification_status", "confidence_score")
    lines = t.incidents(s, d).select(F.struct("incident_id", line.alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\0")
    return lines.agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("version"))


# --- Documents ---------------------------------------------------------------

#: Label and column of each line of an alert's document.
ALERT_LINES = (
    ("Web source", "web_source"), ("Country source", "country_source"), ("Product", "product_name"), ("Category", "product_category"), ("Batch ID", "batch_id"),
    ("Summary", "summary"), ("Reason", "recall_reason"), ("Hazard", "hazard_type"), ("Risk level", "risk_level"), ("Consumer action", "consumer_action"),
)


@query("sk15_full_document", f"WITH {A} SELECT alert_id, md5(concat_ws(chr(10), {', '.join(f'''{n!r} || ': ' || ''' + (f"coalesce(nullif(trim({c}), ''), 'unspecified')" if c == 'batch_id' else f"coalesce({c}, '')") for n, c in ALERT_LINES)}, 'Affected regions: ' || coalesce(nullif(array_to_string(affected_regions, ', '), ''), 'unspecified'), 'Latitude: ' || latitude, 'Longitude: ' || longitude)) AS document FROM a")
def _(s, d):
    value = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unspecified")) if c == "batch_id" else F.coalesce(c, F.lit(""))
    regions = F.coalesce(F.nullif(F.array_join("affected_regions", ", "), F.lit("")), F.lit("unspecified"))
    lines = [F.concat(F.lit(f"{n}: "), value(c)) for n, c in ALERT_LINES]
    doc = F.concat_ws("\n", *lines, F.concat(F.lit("Affected regions: "), regions), F.concat(F.lit("Latitude: "), "latitude"), F.concat(F.lit("Longitude: "), "longitude"))
    return t.alerts(s, d).select("alert_id", F.md5(doc).alias("document"))


@query("tx17_official_document", f"WITH {A} SELECT alert_id, md5(concat_ws(chr(10), 'Product: ' || coalesce(product_name, ''), 'Hazard: ' || coalesce(hazard_type, ''), 'Country: ' || coalesce(country_source, ''), 'Reason: ' || coalesce(recall_reason, ''), 'Summary: ' || coalesce(summary, ''))) AS document FROM a")
def _(s, d):
    line = lambda n, c: F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit("")))
    doc = F.concat_ws("\n", line("Product", "product_name"), line("Hazard", "hazard_type"), line("Country", "country_source"), line("Reason", "recall_reason"), line("Summary", "summary"))
    return t.alerts(s, d).select("alert_id", F.md5(doc).alias("document"))


@query("sk16_metadata", f"WITH {A} SELECT alert_id, to_json(coalesce(affected_regions, []))::varchar AS affected_regions, nullif(trim(batch_id), '') AS batch_id, strftime(recall_date, '%Y-%m-%d') AS recall_date FROM a")
def _(s, d):
    regions = F.to_json(F.coalesce("affected_regions", F.array().cast("array<string>")))
    return t.alerts(s, d).select("alert_id", regions.alias("affected_regions"), F.nullif(F.trim("batch_id"), F.lit("")).alias("batch_id"), day("recall_date").alias("recall_date"))


@query("sk17_from_metadata", f"WITH {A} SELECT alert_id, len(coalesce(affected_regions, []))::int AS regions, coalesce(nullif(web_source, ''), 'unknown') AS web_source, strftime(recall_date, '%Y-%m-%d') AS recall_date, coalesce(latitude, 0.0) AS latitude FROM a")
def _(s, d):
    m = t.alerts(s, d).select("alert_id", F.to_json("affected_regions").alias("regions"), "web_source", day("recall_date").alias("recall_date"), F.col("latitude").cast("string").alias("latitude"))
    back = F.coalesce(F.from_json("regions", "array<string>"), F.array().cast("array<string>"))
    return m.select("alert_id", F.size(back).alias("regions"), F.coalesce(F.nullif("web_source", F.lit("")), F.lit("unknown")).alias("web_source"), "recall_date", F.coalesce(F.expr("try_cast(latitude AS double)"), F.lit(0.0)).alias("latitude"))


@query("sk18_sorted_json", "SELECT user_id, md5(to_json({'details': props, 'event_id': event_id, 'kind': event_type, 'run_id': user_id})::varchar) AS document, event_id FROM events")
def _(s, d):
    doc = F.to_json(F.struct(F.col("props").alias("details"), "event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("run_id")), {"ignoreNullFields": "false"})
    return t.events(s, d).select("user_id", F.md5(doc).alias("document"), "event_id")


# --- Warnings: the error events of the run log, acknowledged from a value of 50 on ---

_WARN = "w AS (SELECT event_id, ts, user_id, value >= 50 AS acknowledged FROM events WHERE event_type = 'error')"


def warnings(s, d):
    return t.events(s, d).filter("event_type = 'error'").select("event_id", "ts", "user_id", (F.col("value") >= 50).alias("acknowledged"))


@query("sc11_open_warnings", f"WITH {_WARN} SELECT event_id, user_id FROM w WHERE NOT acknowledged ORDER BY ts DESC")
def _(s, d):
    return warnings(s, d).filter("NOT acknowledged").orderBy(F.desc("ts")).select("event_id", "user_id")


@query("sk08_newest_warnings", f"WITH {_WARN} SELECT event_id FROM w ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(s, d):
    return warnings(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


@query("sk09_acknowledged_all", f"WITH {_WARN} SELECT count(*) FILTER (NOT acknowledged) AS changed, count(*) AS acknowledged FROM w")
def _(s, d):
    return warnings(s, d).agg(F.count_if(~F.col("acknowledged")).alias("changed"), F.count("*").alias("acknowledged"))


@query("ag05_unacknowledged", f"WITH {_WARN} SELECT count(*) FILTER (NOT acknowledged) AS n FROM w")
def _(s, d):
    return warnings(s, d).agg(F.count_if(~F.col("acknowledged")).alias("n"))


@query("wn03_stage_duration", "SELECT event_id, epoch_us(ts) - epoch_us(max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS duration FROM events QUALIFY event_type = 'purchase'")
def _(s, d):
    """A sign-up opens a stage, a purchase closes it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when(F.col("event_type") == "signup", F.unix_micros("ts"))).over(w)
    return t.events(s, d).withColumn("duration", F.unix_micros("ts") - opened).filter("event_type = 'purchase'").select("event_id", "duration")


# --- Stores ------------------------------------------------------------------


@query("sk03_incidents_after_delete", f"WITH {I} SELECT incident_id FROM i WHERE incident_id NOT IN (SELECT incident_id FROM i WHERE verification_status = 'superseded')")
def _(s, d):
    i = t.incidents(s, d).select("incident_id", "verification_status")
    return i.join(i.filter("verification_status = 'superseded'").select("incident_id"), "incident_id", "left_anti").select("incident_id")


@query("sk02_patched_row", f"WITH {A} SELECT alert_id, CASE WHEN alert_id = (SELECT min(alert_id) FROM a) THEN 1.5 ELSE latitude END AS latitude, CASE WHEN alert_id = (SELECT min(alert_id) FROM a) THEN 2.5 ELSE longitude END AS longitude FROM a")
def _(s, d):
    a = table(s, d, "alerts").select("alert_id", "latitude", "longitude").distinct()
    patch = table(s, d, "alerts").agg(F.min("alert_id").alias("alert_id")).select("alert_id", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    return a.join(F.broadcast(patch), "alert_id", "left").select("alert_id", F.coalesce("lat", "latitude").alias("latitude"), F.coalesce("lon", "longitude").alias("longitude"))


@query("sk04_candidate_ids", "WITH o AS (SELECT canonical_url AS u, min(candidate_id) AS id FROM candidates WHERE load_no = 0 GROUP BY 1) SELECT DISTINCT c.candidate_id, coalesce(o.id, c.candidate_id) AS stored_id FROM candidates c LEFT JOIN o ON o.u = c.canonical_url WHERE c.load_no > 0")
def _(s, d):
    c = table(s, d, "candidates").select("candidate_id", "canonical_url", "load_no")
    stored = c.filter("load_no = 0").groupBy("canonical_url").agg(F.min("candidate_id").alias("id"))
    return c.filter("load_no > 0").join(stored, "canonical_url", "left").select("candidate_id", F.coalesce("id", "candidate_id").alias("stored_id")).distinct()


@query("sk10_stale_sources", f"SELECT DISTINCT source_name, CASE WHEN updated_at < TIMESTAMP '2026-01-01' THEN 'stale' ELSE discovery_status END AS status FROM sources")
def _(s, d):
    old = F.col("updated_at") < F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    return t.sources(s, d).select("source_name", F.when(old, "stale").otherwise(F.col("discovery_status")).alias("status"))


@query("sk11_bootstrapped", "SELECT DISTINCT source_name FROM sources WHERE (SELECT count(*) FROM alerts WHERE load_no < 0) = 0")
def _(s, d):
    """Seeds go into a store only while it is empty; the store here is the batch before the first."""
    store = table(s, d, "alerts").filter("load_no < 0").select("web_source").limit(1)
    return t.sources(s, d).select("source_name").join(store, F.lit(True), "left_anti")


@query("st08_marked", f"WITH {C} SELECT candidate_id, CASE WHEN decision = 'accept' THEN 'classified' ELSE processing_status END AS status, attempt_count + CASE WHEN decision = 'accept' THEN 1 ELSE 0 END AS attempts, CASE WHEN decision = 'accept' THEN '' ELSE coalesce(last_error, '') END AS last_error FROM c")
def _(s, d):
    now = F.col("decision") == "accept"
    return t.candidates(s, d).select(
        "candidate_id", F.when(now, "classified").otherwise(F.col("processing_status")).alias("status"), (F.col("attempt_count") + F.when(now, 1).otherwise(0)).alias("attempts"),
        F.when(now, "").otherwise(F.coalesce("last_error", F.lit(""))).alias("last_error"),
    )


@query("st09_query_state", f"WITH {C}, q AS (SELECT unnest(query_ids) AS query_id, last_seen_at FROM c) SELECT query_id, count(*) AS search_count, {MOMENT.format('max(last_seen_at)')} AS last_searched FROM q GROUP BY 1")
def _(s, d):
    q = t.candidates(s, d).select(F.explode("query_ids").alias("query_id"), "last_seen_at")
    return q.groupBy("query_id").agg(F.count("*").alias("search_count"), moment(F.max("last_seen_at")).alias("last_searched"))


@query("ag16_rotation_index", f"WITH {C}, q AS (SELECT unnest(query_ids) AS query_id FROM c) SELECT (count(*) // greatest(1, 12))::bigint AS rotation FROM q")
def _(s, d):
    return t.candidates(s, d).select(F.explode("query_ids")).agg(F.floor(F.count("*") / F.lit(12)).cast("bigint").alias("rotation"))


@query("st10_touched", "SELECT DISTINCT source_name, strftime(coalesce(discovered_at, TIMESTAMP '2026-03-31'), '%Y-%m-%d') AS discovered, CASE WHEN discovery_status IS NULL THEN 'ready' ELSE discovery_status END AS status FROM sources")
def _(s, d):
    return t.sources(s, d).select("source_name", day(F.coalesce("discovered_at", F.to_timestamp(F.lit(f"{AS_OF}T00:00:00Z")))).alias("discovered"), F.coalesce("discovery_status", F.lit("ready")).alias("status"))


# --- Matching ----------------------------------------------------------------


@query("jn01_best_match")
def _(s, d):
    """The first strategy that finds another incident decides: address, content hash, title, then names and date."""
    found = None
    trimmed = F.lower(F.regexp_replace(F.col("e.content_hash"), r"^\s+|\s+$", ""))
    titles = linking._evidence(s, d).select("id", text.folded(F.col("e.title")).alias("title"))
    parts = (
        linkage.smallest_partner(linking.incident_urls(s, d)),
        linkage.smallest_partner(linking._evidence(s, d).select("id", trimmed.alias("key"))),
        linkage.smallest_partner(titles.select("id", F.when(F.col("title") != "", F.sha2("title", 256)).alias("key"))),
        linkage.entity_date_pairs(linking.incident_entities(s, d).drop("hazard_raw")).groupBy("id").agg(F.min("other_id").alias("other_id")),
    )
    for n, part in enumerate(parts):
        part = part.select("id", F.struct(F.lit(n).alias("n"), "other_id").alias("m"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min("m").alias("m"))
    kinds = F.array(*map(F.lit, ("exact_url", "content_hash", "title", "entity_date")))
    return best.select("id", F.element_at(kinds, F.col("m.n") + 1).alias("kind"), "m.other_id")


_NAMES = "list_sort(list_distinct(regexp_extract_all(lower(strip_accents(replace({}, '&', ' and '))), '[\\p{{L}}\\p{{N}}_]+')))"


@query("jn07_contained_names", f"WITH x AS (SELECT product_name FROM incidents UNION SELECT product_name FROM alerts), n AS (SELECT DISTINCT {_NAMES.format('product_name')} AS w FROM x WHERE product_name IS NOT NULL), p AS (SELECT array_to_string(a.w, ' ') AS l, array_to_string(b.w, ' ') AS r FROM n a JOIN n b ON a.w <> b.w AND len(a.w) >= 2 AND list_has_all(b.w, a.w)) SELECT DISTINCT l, r FROM p")
def _(s, d):
    """Distinct product names, as sorted words, of which one holds all words of the other."""
    words = F.array_sort(F.array_distinct(F.split(text.folded(F.col("product_name")), " ")))
    every = table(s, d, "incidents").select("product_name").unionByName(table(s, d, "alerts").select("product_name")).filter("product_name IS NOT NULL").distinct()
    n = every.select(F.array_join(words, " ").alias("w")).filter("w <> ''").distinct()
    n = n.select("w", F.split("w", " ").alias("tokens"))
    held = linkage.contains_tokens(n.filter(F.size("tokens") >= 2).withColumnRenamed("w", "a"), n.withColumnRenamed("w", "b"))
    return held.filter("a <> b").select(F.col("a").alias("l"), F.col("b").alias("r"))


@query("jn10_already_processed", f"WITH {C}, h AS (SELECT lower(trim(e.content_hash)) AS h FROM (SELECT unnest(evidence) AS e FROM incidents) UNION SELECT lower(trim(content_hash)) FROM candidates WHERE load_no = 0) SELECT candidate_id FROM c WHERE load_no > 0 AND trim(content_hash) <> '' AND lower(trim(content_hash)) IN (SELECT h FROM h WHERE h IS NOT NULL)")
def _(s, d):
    """Arriving candidates whose content stands in an incident's evidence or was accepted before."""
    tidy = lambda c: F.lower(F.trim(c)).alias("h")
    evidence = table(s, d, "incidents").select(F.explode("evidence.content_hash").alias("h")).select(tidy("h"))
    before = table(s, d, "candidates").filter("load_no = 0").select(tidy("content_hash"))
    c = t.candidates(s, d).filter("load_no > 0").select("candidate_id", tidy("content_hash")).filter("h <> ''")
    return c.join(evidence.unionByName(before).distinct(), "h", "left_semi").select("candidate_id")


@query("jn13_place_alias", f"WITH {I}, p AS (SELECT DISTINCT trim(regexp_replace(lower(strip_accents(country)), '[^a-z0-9]+', ' ', 'g')) AS place FROM i WHERE country IS NOT NULL), s AS (SELECT DISTINCT country_source AS c, trim(regexp_replace(lower(strip_accents(country_source)), '[^a-z0-9]+', ' ', 'g')) AS alias FROM sources) SELECT DISTINCT p.place, s.c FROM p JOIN s ON p.place = s.alias OR (length(s.alias) > 3 AND contains(' ' || p.place || ' ', ' ' || s.alias || ' '))")
def _(s, d):
    """Places that name a source's country, alone or as whole words; both sides are distinct names."""
    p = t.incidents(s, d, "country IS NOT NULL").select(text.place(F.col("country")).alias("place")).distinct()
    a = t.sources(s, d).select(F.col("country_source").alias("c"), text.place(F.col("country_source")).alias("alias")).distinct()
    words = F.split("place", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    met = p.select("place", F.explode(F.array_distinct(runs)).alias("alias")).join(a, "alias")
    return met.filter((F.col("place") == F.col("alias")) | (F.length("alias") > 3)).select("place", "c").distinct()


@query("jn22_sources_with_history", "SELECT DISTINCT a.web_source, s.source_name IS NOT NULL AS known FROM alerts a LEFT JOIN sources s ON s.source_name = a.web_source")
def _(s, d):
    names = t.sources(s, d).select(F.col("source_name").alias("web_source"), F.lit(True).alias("held"))
    return table(s, d, "alerts").select("web_source").distinct().join(names, "web_source", "left").select("web_source", F.coalesce("held", F.lit(False)).alias("known"))


@query("hs03_cluster_fingerprint")
def _(s, d):
    e = linking.incident_entities(s, d)
    url = t.incidents(s, d).select(F.col("incident_id").alias("id"), urls.canonical(F.col("primary_source_url")).alias("url"))
    named = (F.col("product") != "").cast("int") + (F.col("company") != "").cast("int") + (F.col("hazard") != "").cast("int")
    parts = F.array("product", "company", "hazard", F.coalesce(day("day"), F.lit("")))
    full = F.when(named < 2, F.concat(parts, F.array("url"))).otherwise(parts)
    return e.join(url, "id").select(F.col("id").alias("incident_id"), F.sha2(F.array_join(full, "\0"), 256).alias("fingerprint"))


@query("jn09_verified")
def _(s, d):
    """Unresolved incidents with the official alert that confirms them: status, score, reason, linked ids."""
    open_ = t.incidents(s, d, ~F.col("verification_status").isin(*merge.TERMINAL)).select("incident_id", "linked_official_alert_ids")
    link = linking.QUERIES["jn08_official_link"](s, d)
    ids_ = F.array_distinct(F.concat(F.coalesce("linked_official_alert_ids", F.array().cast("array<string>")), F.array("alert_id")))
    reason = F.concat(F.lit("official recall "), "alert_id", F.lit(" linked by "), "kind", F.lit(": score set to 100"))
    return open_.join(link, "incident_id").select("incident_id", F.lit("officially_confirmed").alias("status"), F.lit(100).alias("score"), reason.alias("reason"), F.array_join(ids_, ",").alias("linked"))


@query("fl09_unresolved", f"WITH {I} SELECT incident_id FROM i WHERE verification_status NOT IN ('dismissed', 'superseded', 'officially_confirmed')")
def _(s, d):
    return t.incidents(s, d, ~F.col("verification_status").isin(*merge.TERMINAL)).select("incident_id")


# --- Merging -----------------------------------------------------------------


def grouped_incidents(s, d):
    """Incidents with their group's ``key``, in the order in which they were first seen."""
    key = F.lower(F.trim("cluster_fingerprint"))
    return t.incidents(s, d).withColumn("key", key).filter("key <> ''").withColumn("_at", F.col("first_discovered_at")).withColumn("_id", F.col("incident_id"))


_G = f"{I}, g AS (SELECT lower(trim(cluster_fingerprint)) AS key, * FROM i WHERE trim(cluster_fingerprint) <> '')"
_LAST = "arg_max({0}, (first_discovered_at, incident_id)) FILTER (coalesce({0}, '') <> '') AS {0}"
_WORDS = "len(list_filter(regexp_split_to_array(trim({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"
_SPECIFIC = "arg_max(trim({0}), (" + _WORDS + ", length(trim({0})), -epoch_us(first_discovered_at))) FILTER (coalesce(trim({0}), '') <> '') AS {0}"
_TERMINAL = "verification_status IN ('dismissed', 'superseded', 'officially_confirmed')"
_URL_KEY = "lower(trim({}))"


def plain_key(u):
    """Addresses without case and outer space: the key that SQL can also write."""
    return F.lower(F.trim(u))


@query("st03_merged_incidents", f"""WITH {_G}, e AS (SELECT key, lower(trim(e.url)) AS u, e, first_discovered_at AS seen, incident_id AS id, pos FROM (SELECT key, first_discovered_at, incident_id, unnest(evidence) AS e, unnest(range(len(evidence))) AS pos FROM g) WHERE e IS NOT NULL AND trim(e.url) <> ''),
p AS (SELECT key, u, arg_max(e.domain, (seen, id, pos)) FILTER (coalesce(e.domain, '') <> '') AS domain, arg_max(e.source_kind, (seen, id, pos)) AS kind FROM e GROUP BY key, u),
k AS (SELECT key, count(DISTINCT coalesce(nullif(lower(trim(domain)), ''), u)) AS n, count(*) AS pages FROM p GROUP BY key),
f AS (SELECT key, count(*) AS records, arg_min(verification_status, (first_discovered_at, incident_id)) AS first_status, arg_min(verification_status, (first_discovered_at, incident_id)) FILTER ({_TERMINAL}) AS terminal,
arg_min(incident_id, (first_discovered_at, incident_id)) AS incident_id, {', '.join(_LAST.format(c) for c in ('summary', 'consumer_guidance', 'publication_date'))}, {', '.join(_SPECIFIC.format(c) for c in merge.LABELS)},
arg_max(trim(country), (length(trim(country)), -epoch_us(first_discovered_at))) FILTER (coalesce(trim(country), '') <> '') AS country, max(extraction_completeness) AS completeness FROM g GROUP BY key)
SELECT key, incident_id, records, CASE WHEN records = 1 THEN first_status WHEN terminal IS NOT NULL THEN terminal WHEN coalesce(n, 1) > 1 OR first_status = 'corroborated' THEN 'corroborated' ELSE 'pending' END AS status,
greatest(1, coalesce(n, 1)) AS independent, coalesce(pages, 0) AS pages, product_name, company_name, hazard_type, country, md5(summary) AS summary, md5(consumer_guidance) AS guidance, publication_date, completeness FROM f LEFT JOIN k USING (key)""")
def _(s, d):
    g = grouped_incidents(s, d)
    m = merge.merge_groups(g, merge.merged_evidence(g, plain_key))
    return m.select(
        "key", "incident_id", "records", F.col("verification_status").alias("status"), "independent", "pages", *merge.LABELS, "country", F.md5("summary").alias("summary"),
        F.md5("consumer_guidance").alias("guidance"), "publication_date", F.col("extraction_completeness").alias("completeness"),
    )


@query("st05_evidence_pages", f"""WITH {_G}, e AS (SELECT key, lower(trim(e.url)) AS u, e, first_discovered_at AS seen, incident_id AS id, pos FROM (SELECT key, first_discovered_at, incident_id, unnest(evidence) AS e, unnest(range(len(evidence))) AS pos FROM g) WHERE e IS NOT NULL AND trim(e.url) <> '')
SELECT key, u AS url_key, arg_max(e.title, (seen, id, pos)) FILTER (coalesce(e.title, '') <> '') AS title, arg_max(e.publisher, (seen, id, pos)) FILTER (coalesce(e.publisher, '') <> '') AS publisher,
strftime(arg_max(e.publication_date, (seen, id, pos)) FILTER (e.publication_date IS NOT NULL), '%Y-%m-%d') AS published FROM e GROUP BY key, u""")
def _(s, d):
    pages = merge.merged_evidence(grouped_incidents(s, d), plain_key)
    return pages.select("key", "url_key", "title", "publisher", day("publication_date").alias("published"))


@query("st05_evidence_canonical")
def _(s, d):
    pages = merge.merged_evidence(grouped_incidents(s, d), urls.canonical)
    return pages.groupBy("key").agg(F.count("*").alias("pages"), F.countDistinct("domain").alias("domains"))


@query("st06_primary_in_evidence", f"WITH {I} SELECT incident_id, len(list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: lower(trim(e.url))), lambda u: u <> '') || list_filter([lower(trim(primary_source_url))], lambda u: u <> '')))::int AS pages FROM i")
def _(s, d):
    none = F.array().cast("array<string>")
    own = F.concat(F.coalesce(F.transform("evidence.url", plain_key), none), F.array(plain_key(F.col("primary_source_url"))))
    return t.incidents(s, d).select("incident_id", F.size(F.array_distinct(F.filter(own, lambda u: u != ""))).alias("pages"))


def _united(column: str) -> None:
    @query(f"se01_united_{column}", f"WITH {_G}, x AS (SELECT key, first_discovered_at AS seen, incident_id AS id, unnest({column}) AS x, unnest(range(len({column}))) AS pos FROM g), f AS (SELECT key, x, min((seen, id, pos)) AS o FROM x WHERE x IS NOT NULL GROUP BY key, x) SELECT key, string_agg(x, '|' ORDER BY o) AS items FROM f GROUP BY key")
    def _(s, d):
        return merge.united(grouped_incidents(s, d), column).select("key", F.array_join(column, "|").alias("items"))


for _u in merge.UNITED:
    _united(_u)


@query("wn07_preferred_labels", f"WITH {_G} SELECT key, {_SPECIFIC.format('company_name')} FROM g GROUP BY key")
def _(s, d):
    return grouped_incidents(s, d).groupBy("key").agg(merge.most_specific("company_name").alias("company_name"))


@query("wn08_preferred_country", f"WITH {_G} SELECT key, arg_max(trim(country), (length(trim(country)), -epoch_us(first_discovered_at))) FILTER (coalesce(trim(country), '') <> '') AS country FROM g GROUP BY key")
def _(s, d):
    return grouped_incidents(s, d).groupBy("key").agg(merge.longest("country").alias("country"))


_SOURCES = "greatest(1, len(list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: coalesce(nullif(lower(trim(e.domain)), ''), nullif(lower(trim(e.url)), ''))), lambda x: x IS NOT NULL))))"


def _sources_of():
    named = F.transform("evidence", lambda e: F.coalesce(F.nullif(F.lower(F.trim(e["domain"])), F.lit("")), F.nullif(F.lower(F.trim(e["url"])), F.lit(""))))
    return F.greatest(F.lit(1), F.coalesce(F.size(F.array_distinct(F.array_compact(named))), F.lit(0)))


def _held(c):
    return F.coalesce(c, F.lit("")) != ""


@query("pr05_incident_confidence", f"WITH {I}, x AS (SELECT incident_id, verification_status = 'officially_confirmed' OR len(coalesce(linked_official_alert_ids, [])) > 0 AS sure, {_WEIGHT.format('source_kind')} + least(({_SOURCES} - 1) * 5, 15) + CASE WHEN coalesce(product_name, '') <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(hazard_type, '') <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(publication_date, '') <> '' THEN 2 ELSE 0 END AS score FROM i) SELECT incident_id, CASE WHEN sure THEN 100 ELSE least(99, greatest(0, score)) END::bigint AS score FROM x")
def _(s, d):
    official = (F.col("verification_status") == "officially_confirmed") | (F.coalesce(F.size("linked_official_alert_ids"), F.lit(0)) > 0)
    score, _reasons = scoring.confidence(F.col("source_kind"), _sources_of(), _held("product_name"), _held("hazard_type"), _held("publication_date"), official=official)
    return t.incidents(s, d).select("incident_id", score.cast("bigint").alias("score"))


@query("pr04_confidence_reasons", f"WITH {I}, x AS (SELECT incident_id, coalesce(source_kind, 'unknown') AS kind, {_WEIGHT.format('source_kind')} AS base, {_SOURCES} - 1 AS more, coalesce(product_name, '') <> '' AS p, coalesce(hazard_type, '') <> '' AS h, trust_tier IN ('official', 'high') AS tr, year(last_discovered_at) < 2025 AS stale, length(coalesce(summary, '')) < 200 AS vague FROM i), y AS (SELECT *, base + least(more * 5, 15) + CASE WHEN p THEN 4 ELSE 0 END + CASE WHEN h THEN 4 ELSE 0 END + CASE WHEN tr THEN 5 ELSE 0 END - CASE WHEN stale THEN 10 ELSE 0 END - CASE WHEN vague THEN 10 ELSE 0 END AS score FROM x) SELECT incident_id, least(99, greatest(0, score))::bigint AS score, array_to_string(list_filter(['source kind ' || kind || ': base ' || base, CASE WHEN more > 0 THEN more || ' independent corroborating source(s): +' || least(more * 5, 15) END, CASE WHEN p THEN 'explicit product evidence: +4' END, CASE WHEN h THEN 'explicit hazard evidence: +4' END, CASE WHEN tr THEN 'trusted-domain override: +5' END, CASE WHEN stale THEN 'stale reporting: -10' END, CASE WHEN vague THEN 'vague reporting: -10' END, CASE WHEN least(99, greatest(0, score)) <> score THEN 'unofficial confidence bounded to ' || least(99, greatest(0, score)) END], lambda x: x IS NOT NULL), '; ') AS reasons FROM y")
def _(s, d):
    trusted, stale = F.col("trust_tier").isin("official", "high"), F.year("last_discovered_at") < 2025
    score, reasons = scoring.confidence(F.col("source_kind"), _sources_of(), _held("product_name"), _held("hazard_type"), F.lit(False), trusted, stale, F.length(F.coalesce("summary", F.lit(""))) < 200)
    return t.incidents(s, d).select("incident_id", score.cast("bigint").alias("score"), F.array_join(reasons, "; ").alias("reasons"))


@query("tx18_bounded_label", f"WITH {I}, x AS (SELECT incident_id, least(greatest(floor(confidence_score + 0.5), 0), 100)::int AS n FROM i) SELECT incident_id, n, CASE WHEN n >= 85 THEN 'very high' WHEN n >= 70 THEN 'high' WHEN n >= 50 THEN 'medium' ELSE 'low' END AS label FROM x")
def _(s, d):
    n = text.bounded_score(F.col("confidence_score"))
    return t.incidents(s, d).select("incident_id", n.alias("n"), text.confidence_label(n).alias("label"))


@query("tx09_headers", f"WITH {C}, x AS (SELECT candidate_id, {HEADER_SQL.format('title')} AS h FROM c) SELECT candidate_id, CASE WHEN length(h) > 160 OR h[1:1] IN ('{{', '[') THEN '' ELSE h END AS header FROM x")
def _(s, d):
    return t.candidates(s, d).select("candidate_id", text.header(F.col("title")).alias("header"))


@query("tx10_places", f"WITH {I} SELECT incident_id, coalesce(trim(regexp_replace(lower(strip_accents(country)), '[^a-z0-9]+', ' ', 'g')), '') AS place FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", text.place(F.col("country")).alias("place"))


@query("tx04_first_text", f"WITH {I} SELECT incident_id, trim(regexp_replace(coalesce(nullif(trim(analyst_notes), ''), nullif(trim(consumer_guidance), ''), nullif(trim(summary), ''), ''), '\\s+', ' ', 'g')) AS first_text FROM i")
def _(s, d):
    first = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("analyst_notes", "consumer_guidance", "summary")), F.lit(""))
    return t.incidents(s, d).select("incident_id", text.collapse(first).alias("first_text"))


@query("hs01_nul_parts", f"WITH {A} SELECT alert_id, sha256(coalesce(product_name, '') || chr(0) || coalesce(batch_id, '')) AS key FROM a")
def _(s, d):
    return t.alerts(s, d).select("alert_id", ids.nul_hash(F.col("product_name"), F.col("batch_id")).alias("key"))
