"""Queries of dates, crawl predicates, summaries of runs, and small writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brackwater.functions import dates, scoring, text, urls
from brackwater.plans.serving import A, AS_OF, C, I, day, moment, MOMENT
from brackwater.runtime import table
from brackwater.sources import tables as t

QUERIES, ORACLES = {}, {}
#: Label and column of each line of an incident's embedding document.
INCIDENT_LINES = (
    ("Product", "product_name"), ("Company", "company_name"), ("Hazard", "hazard_type"),
    ("Country", "country"), ("Reason", "incident_reason"), ("Summary", "summary"),
)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("sc06_candidate_by_url", f"WITH {C} SELECT candidate_id, canonical_url FROM c WHERE canonical_url = (SELECT min(canonical_url) FROM candidates)")
def _(s, d):
    wanted = table(s, d, "candidates").agg(F.min("canonical_url").alias("canonical_url"))
    return t.candidates(s, d).join(F.broadcast(wanted), "canonical_url", "left_semi").select("candidate_id", "canonical_url")


@query("fl16_plausible_dates", f"WITH {A} SELECT alert_id FROM a WHERE recall_date BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}'")
def _(s, d):
    return t.alerts(s, d, dates.plausible(F.col("recall_date"), AS_OF)).select("alert_id")


@query("fl21_no_future_date", f"WITH {A} SELECT alert_id, strftime(CASE WHEN recall_date <= DATE '{AS_OF}' THEN recall_date END, '%Y-%m-%d') AS recall_date FROM a")
def _(s, d):
    kept = F.when(F.col("recall_date") <= F.lit(AS_OF).cast("date"), F.col("recall_date"))
    return t.alerts(s, d).select("alert_id", day(kept).alias("recall_date"))


@query("dt14_safe_date", f"WITH {I} SELECT incident_id, strftime(try_cast(nullif(regexp_extract(trim(publication_date), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS date), '%Y-%m-%d') AS day FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", day(dates.safe_date(F.col("publication_date"))).alias("day"))


@query("dt02_dotted_date", f"WITH {I} SELECT incident_id, strftime(try_strptime(nullif(regexp_extract(trim(publication_date), '^([0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}})$', 1), ''), '%d.%m.%Y'), '%Y-%m-%d') AS day FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", day(dates.dotted_date(F.col("publication_date"))).alias("day"))


@query("dt01_numeric_readings", "WITH f AS (SELECT DISTINCT numero_fiche, nullif(regexp_extract(trim(date_publication), '^([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '') AS w FROM france_recall), r AS (SELECT numero_fiche, strftime(try_strptime(w, '%d/%m/%Y'), '%Y-%m-%d') AS a, strftime(try_strptime(w, '%m/%d/%Y'), '%Y-%m-%d') AS b FROM f) SELECT numero_fiche, concat_ws(',', a, CASE WHEN b IS DISTINCT FROM a THEN b END) AS days FROM r")
def _(s, d):
    f = table(s, d, "france_recall").select("numero_fiche", "date_publication").distinct()
    days = F.transform(dates.numeric_readings(F.col("date_publication")), day)
    return f.select("numero_fiche", F.coalesce(F.array_join(days, ","), F.lit("")).alias("days"))


@query("dt13_next_retry", f"WITH {C} SELECT candidate_id, {MOMENT.format('last_seen_at + INTERVAL 360 MINUTE')} AS next_retry FROM c")
def _(s, d):
    return t.candidates(s, d).select("candidate_id", moment(F.col("last_seen_at") + F.expr("INTERVAL 360 MINUTES")).alias("next_retry"))


@query("tx07_collapsed", f"WITH {C} SELECT candidate_id, md5(trim(regexp_replace(description, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS body FROM c")
def _(s, d):
    return t.candidates(s, d).select("candidate_id", F.md5(text.collapse(F.col("description"))).alias("body"))


@query("tx14_regions", f"WITH {A} SELECT alert_id, array_to_string(list_filter(list_transform(affected_regions, lambda x: trim(x)), lambda x: x <> ''), ', ') AS regions FROM a")
def _(s, d):
    kept = F.filter(F.transform("affected_regions", F.trim), lambda x: x != "")
    return t.alerts(s, d).select("alert_id", F.array_join(kept, ", ").alias("regions"))


@query("pr06_base_weight", f"WITH {I} SELECT incident_id, (CASE source_kind {' '.join(f'WHEN {k!r} THEN {v}' for k, v in scoring.BASE_WEIGHTS.items())} ELSE 40 END)::bigint AS w FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", scoring.base_weight(F.col("source_kind")).cast("bigint").alias("w"))


@query("pr10_stage_key", "SELECT event_id, event_type || '::' || coalesce(nullif(props, ''), '*') AS stage_key FROM events")
def _(s, d):
    return t.events(s, d).select("event_id", F.concat("event_type", F.lit("::"), F.coalesce(F.nullif("props", F.lit("")), F.lit("*"))).alias("stage_key"))


@query("pr11_geocode_text", f"WITH {A}, r AS (SELECT DISTINCT trim(unnest(affected_regions)) AS region, country_source FROM a) SELECT DISTINCT concat_ws(', ', region, nullif(country_source, '')) AS q FROM r WHERE region <> ''")
def _(s, d):
    r = t.alerts(s, d).select(F.explode(F.transform("affected_regions", F.trim)).alias("region"), "country_source").filter("region <> ''")
    return r.select(F.concat_ws(", ", "region", F.nullif("country_source", F.lit(""))).alias("q")).distinct()


@query("ag15_run_statistics", "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean_value, count(*) FILTER (value > 50) AS slow FROM events GROUP BY 1")
def _(s, d):
    return t.events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_value"), F.count_if(F.col("value") > 50).alias("slow"))


@query("ag17_run_metrics", f"WITH {C} SELECT processing_status, decision, count(*) AS n, sum(attempt_count)::bigint AS attempts FROM c GROUP BY ALL")
def _(s, d):
    return t.candidates(s, d).groupBy("processing_status", "decision").agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"))


@query("ag18_confirmed", f"WITH {I} SELECT count(*) FILTER (verification_status = 'officially_confirmed') AS confirmed, count(*) AS total FROM i")
def _(s, d):
    return t.incidents(s, d).agg(F.count_if(F.col("verification_status") == "officially_confirmed").alias("confirmed"), F.count("*").alias("total"))


@query("st04_official_links", f"WITH {I} SELECT incident_id, CASE WHEN len(list_filter(linked_official_alert_ids, lambda x: trim(x) <> '')) > 0 THEN 'officially_confirmed' ELSE verification_status END AS status FROM i")
def _(s, d):
    linked = F.size(F.filter("linked_official_alert_ids", lambda x: F.trim(x) != "")) > 0
    return t.incidents(s, d).select("incident_id", F.when(linked, "officially_confirmed").otherwise(F.col("verification_status")).alias("status"))


@query("st16_retry_state", f"WITH {C} SELECT candidate_id, CASE WHEN processing_status <> 'retryable' THEN processing_status WHEN attempt_count + 1 >= 3 THEN 'fetch_failed' ELSE 'retryable' END AS next_status FROM c")
def _(s, d):
    after = F.when(F.col("processing_status") != "retryable", F.col("processing_status")).when(F.col("attempt_count") + 1 >= 3, "fetch_failed").otherwise("retryable")
    return t.candidates(s, d).select("candidate_id", after.alias("next_status"))


@query("tx16_full_document", f"WITH {I} SELECT incident_id, concat_ws(chr(10), {', '.join(f"CASE WHEN trim({c}, e' \\t\\n\\r') <> '' THEN '{n}: ' || {c} END" for n, c in INCIDENT_LINES)}) AS document FROM i")
def _(s, d):
    line = lambda n, c: F.when(F.regexp_replace(c, r"\s+", "") != "", F.concat(F.lit(f"{n}: "), F.col(c)))
    return t.incidents(s, d).select("incident_id", F.concat_ws("\n", *(line(n, c) for n, c in INCIDENT_LINES)).alias("document"))


@query("sc10_run_log_all", "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest FROM events")
def _(s, d):
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events(s, d).select("user_id", "event_id", "event_type", newest.alias("newest"))


@query("ag15_model_statistics", "SELECT event_type AS model, count(*) AS cases, round(count(*) FILTER (value <= 50) / count(*), 6) AS success, round(avg(value), 4) AS seconds, round(avg(value) FILTER (value <= 50), 4) AS seconds_of_successes FROM events GROUP BY 1")
def _(s, d):
    """Each kind of event as a model whose case succeeds within 50 seconds; some averages cover the successes only."""
    ok = F.col("value") <= 50
    g = t.events(s, d).groupBy(F.col("event_type").alias("model"))
    return g.agg(F.count("*").alias("cases"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success"), F.round(F.avg("value"), 4).alias("seconds"), F.round(F.avg(F.when(ok, F.col("value"))), 4).alias("seconds_of_successes"))


#: The counters of a run: name and the candidates that each counts.
COUNTERS = (
    ("discovered", "true"), ("accepted", "decision = 'accept'"), ("borderline", "decision = 'borderline'"), ("rejected", "decision = 'reject'"),
    ("converted", "processing_status = 'converted'"), ("classified", "processing_status = 'classified'"), ("retryable", "processing_status = 'retryable'"),
    ("fetch_failed", "processing_status = 'fetch_failed'"), ("unsupported", "processing_status = 'unsupported_content'"), ("linked", "linked_incident_id <> ''"),
    ("with_content", "content_hash <> ''"), ("errors", "last_error <> ''"),
)


@query("ag17_run_counters", f"WITH {C} SELECT load_no, " + ", ".join(f"count(*) FILTER ({w}) AS {n}" for n, w in COUNTERS) + " FROM c GROUP BY load_no")
def _(s, d):
    return t.candidates(s, d).groupBy("load_no").agg(*(F.count_if(F.expr(w)).alias(n) for n, w in COUNTERS))


@query("pr16_retry_delay", f"WITH {C} SELECT candidate_id, (2.0 * power(2, greatest(attempt_count, 0)))::double AS seconds FROM c")
def _(s, d):
    return t.candidates(s, d).select("candidate_id", (F.lit(2.0) * F.pow(F.lit(2), F.greatest("attempt_count", F.lit(0)))).alias("seconds"))


@query("pr13_jittered", f"WITH {A} SELECT alert_id FROM a WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(s, d):
    """Coordinates moved by at most a tenth of a degree, the same for an alert at every run, within the world's bounds."""
    part = lambda n: (F.pmod(F.xxhash64("alert_id", F.lit(n)), F.lit(2001)) - 1000) / 10000
    lat, lon = F.col("latitude") + part(1), F.col("longitude") + part(2)
    near = (F.abs(lat - F.col("latitude")) <= 0.1001) & (F.abs(lon - F.col("longitude")) <= 0.1001)
    return t.alerts(s, d, F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).filter(near & lat.between(-90.1, 90.1)).select("alert_id")
