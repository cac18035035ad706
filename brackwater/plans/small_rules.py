"""Queries of small rules: form states, labels, source profiles, coordinates, stage messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brackwater.functions import urls
from brackwater.plans.serving import A, C, I
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


#: The levels that a search form offers.
RISK_LEVELS = ("High", "Medium", "Low", "Unknown")
#: Centres of countries.
CENTRES = {"France": (46.2276, 2.2137), "Germany": (51.1657, 10.4515), "UK": (55.3781, -3.4360), "United Kingdom": (55.3781, -3.4360)}
#: Content that needs a named product.
NAMED_TYPES = ("official_recall", "potential_recall", "company_withdrawal")
#: Trust in a source by its kind where nothing else is set.
DEFAULT_TRUST = {"official_recall": "official", "government_investigation": "official", "who_fao": "high", "company_release": "high", "major_news": "medium", "trade_publication": "medium", "blog": "low"}
#: Words that name no food.
NON_FOOD = (
    "appliance", "automobile", "battery", "car", "charger", "computer", "cosmetic", "electronics", "electronic device", "furniture", "laptop",
    "mobile phone", "motorcycle", "power bank", "smartphone", "television", "toy", "tyre", "vehicle", "appareil electronique", "telephone",
    "jouet", "meuble", "cosmetique", "fahrzeug", "elektronik", "elektrogerat", "spielzeug",
)
#: Colours of pins by risk.
COLOURS = {"High": "#b91c1c", "Medium": "#f59e0b", "Low": "#047857", "Unknown": "#475569"}
#: What a message says when a stage ends.
END_MARKERS = ("completed", "finished", "failed", "processed successfully", "processing failed")


@query("fl19_needs_product", f"WITH {I} SELECT incident_id FROM i WHERE incident_type IN {NAMED_TYPES}")
def _(s, d):
    return t.incidents(s, d, F.col("incident_type").isin(*NAMED_TYPES)).select("incident_id")


@query("fl20_non_food", f"WITH {I} SELECT incident_id FROM i WHERE regexp_matches(' ' || regexp_replace(lower(strip_accents(concat_ws(' ', product_name, product_category, incident_reason))), '[^a-z0-9]+', ' ', 'g') || ' ', ' ({'|'.join(NON_FOOD)}) ')")
def _(s, d):
    """Whole words of a block list in product, category or reason; accents are ignored."""
    plain = F.lower(F.concat_ws(" ", "product_name", "product_category", "incident_reason"))
    plain = F.translate(plain, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = F.concat(F.lit(" "), F.regexp_replace(plain, "[^a-z0-9]+", " "), F.lit(" "))
    return t.incidents(s, d).filter(words.rlike(f" ({'|'.join(NON_FOOD)}) ")).select("incident_id")


@query("fl24_form_state", f"WITH {A} SELECT alert_id, CASE WHEN risk_level IN {RISK_LEVELS} THEN risk_level ELSE 'All' END AS risk_level, CASE WHEN regexp_matches(coalesce(strftime(recall_date, '%Y-%m-%d'), ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN strftime(recall_date, '%Y-%m-%d') ELSE '' END AS recall_date FROM a")
def _(s, d):
    """Parameters as a form takes them: unknown values become the default."""
    date = F.coalesce(F.date_format("recall_date", "yyyy-MM-dd"), F.lit(""))
    return t.alerts(s, d).select("alert_id", F.when(F.col("risk_level").isin(*RISK_LEVELS), F.col("risk_level")).otherwise("All").alias("risk_level"), F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date).otherwise("").alias("recall_date"))


@query("fl23_active_filters", f"WITH {A} SELECT alert_id, coalesce(trim(batch_id), '') <> '' OR coalesce(risk_level, 'All') IN {RISK_LEVELS} AS active FROM a")
def _(s, d):
    chosen = F.when(F.col("risk_level").isin(*RISK_LEVELS), F.col("risk_level")).otherwise("All")
    return t.alerts(s, d).select("alert_id", ((F.coalesce(F.trim("batch_id"), F.lit("")) != "") | (chosen != "All")).alias("active"))


@query("fl25_confidence_input", f"WITH {I}, x AS (SELECT incident_id, try_cast(trim(consumer_guidance) AS double) AS a, try_cast(confidence_score::varchar AS double) AS b FROM i) SELECT incident_id, CASE WHEN a BETWEEN 0 AND 100 THEN a::int::varchar ELSE '' END AS typed, CASE WHEN b BETWEEN 0 AND 100 THEN b::int::varchar ELSE '' END AS given FROM x")
def _(s, d):
    """A number from 0 to 100 as text, else blank."""
    read = lambda c: F.expr(f"try_cast(trim({c}) AS double)")
    tidy = lambda n: F.when(n.between(0, 100), n.cast("int").cast("string")).otherwise("")
    return t.incidents(s, d).select("incident_id", tidy(read("consumer_guidance")).alias("typed"), tidy(read("confidence_score")).alias("given"))


@query("tx19_count_labels", f"WITH {A} SELECT country_source, CASE WHEN count(*) = 1 THEN 'Showing 1 result' ELSE 'Showing ' || count(*) || ' results' END AS label FROM a GROUP BY 1")
def _(s, d):
    n = F.count("*")
    return t.alerts(s, d).groupBy("country_source").agg(F.when(n == 1, "Showing 1 result").otherwise(F.concat(F.lit("Showing "), n, F.lit(" results"))).alias("label"))


@query("tx13_coerced_lists", f"WITH {I} SELECT incident_id, array_to_string(list_filter(list_transform(affected_regions, lambda x: trim(x)), lambda x: x <> ''), '; ') AS text FROM i")
def _(s, d):
    kept = F.filter(F.transform("affected_regions", F.trim), lambda x: x != "")
    return t.incidents(s, d).select("incident_id", F.array_join(kept, "; ").alias("text"))


_TRUST = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEFAULT_TRUST.items()) + " ELSE 'unknown' END"


@query("pr07_source_profiles", f"WITH {I}, x AS (SELECT incident_id, coalesce(nullif(source_kind, ''), 'unknown') AS k, CASE WHEN lower(trim(trust_tier)) IN ('official', 'high', 'medium', 'low') THEN lower(trim(trust_tier)) END AS tr FROM i) SELECT incident_id, k AS kind, coalesce(tr, {_TRUST}) AS trust FROM x")
def _(s, d):
    """A configured tier wins, else the kind's default."""
    kind = F.coalesce(F.nullif("source_kind", F.lit("")), F.lit("unknown"))
    own = F.lower(F.trim("trust_tier"))
    default = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in DEFAULT_TRUST.items() for x in kv)), kind), F.lit("unknown"))
    return t.incidents(s, d).select("incident_id", kind.alias("kind"), F.when(own.isin("official", "high", "medium", "low"), own).otherwise(default).alias("trust"))


@query("pr08_decision_strength", f"WITH {C} SELECT candidate_id, CASE decision WHEN 'accept' THEN 2 WHEN 'borderline' THEN 1 ELSE 0 END AS strength FROM c")
def _(s, d):
    return t.candidates(s, d).select("candidate_id", F.when(F.col("decision") == "accept", 2).when(F.col("decision") == "borderline", 1).otherwise(0).alias("strength"))


@query("pr09_stage_messages", f"WITH {C} SELECT candidate_id, regexp_matches(lower(trim(coalesce(last_error, ''))), '^starting ') OR ends_with(lower(trim(coalesce(last_error, ''))), ' started') AS begins, regexp_matches(lower(coalesce(last_error, '')), '{'|'.join(END_MARKERS)}') AS ends FROM c")
def _(s, d):
    m = F.lower(F.trim(F.coalesce("last_error", F.lit(""))))
    return t.candidates(s, d).select("candidate_id", (F.startswith(m, F.lit("starting ")) | F.endswith(m, F.lit(" started"))).alias("begins"), m.rlike("|".join(END_MARKERS)).alias("ends"))


_CENTRE = "map([" + ", ".join(f"'{k}'" for k in CENTRES) + "], [" + ", ".join(f"[{a}, {b}]" for a, b in CENTRES.values()) + "])"


@query("pr12_fallback_coordinates", f"WITH {A}, x AS (SELECT alert_id, coalesce({_CENTRE}[trim(country_source)], [0.0, 0.0]) AS p FROM a) SELECT alert_id, p[1]::double AS lat, p[2]::double AS lon FROM x")
def _(s, d):
    """The centre of the country by its name as written, then with capitals, else zero."""
    centres = F.create_map(*(x for k, (a, b) in CENTRES.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))))
    name = F.trim("country_source")
    p = F.coalesce(F.try_element_at(centres, name), F.try_element_at(centres, F.initcap(name)), F.array(F.lit(0.0), F.lit(0.0)))
    return t.alerts(s, d).select("alert_id", F.element_at(p, 1).alias("lat"), F.element_at(p, 2).alias("lon"))


@query("pr14_location_strategy", f"WITH {A}, x AS (SELECT alert_id, len(list_filter(affected_regions, lambda r: trim(r) <> '')) AS n FROM a) SELECT alert_id, CASE WHEN coalesce(n, 0) = 0 THEN 'country' WHEN n = 1 THEN 'region' ELSE 'mean of regions' END AS strategy FROM x")
def _(s, d):
    n = F.coalesce(F.size(F.filter("affected_regions", lambda r: F.trim(r) != "")), F.lit(0))
    return t.alerts(s, d).select("alert_id", F.when(n == 0, "country").when(n == 1, "region").otherwise("mean of regions").alias("strategy"))


@query("pr19_map_pins", f"WITH {A} SELECT alert_id, latitude AS lat, longitude AS lng, CASE risk_level {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in COLOURS.items())} ELSE '#475569' END AS colour FROM a WHERE latitude <> 0 OR longitude <> 0")
def _(s, d):
    colour = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), "risk_level"), F.lit(COLOURS["Unknown"]))
    return t.alerts(s, d, "latitude <> 0 OR longitude <> 0").select("alert_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), colour.alias("colour"))


@query("sc08_query_states", f"WITH {C}, q AS (SELECT unnest(query_ids) AS query_id FROM c) SELECT query_id, count(*) AS searches FROM q GROUP BY 1 ORDER BY query_id")
def _(s, d):
    return t.candidates(s, d).select(F.explode("query_ids").alias("query_id")).groupBy("query_id").agg(F.count("*").alias("searches")).orderBy("query_id")


@query("sk05_query_upsert", "WITH q AS (SELECT unnest(query_ids) AS query_id, load_no FROM candidates) SELECT query_id, CASE WHEN min(load_no) = 0 AND max(load_no) > 0 THEN 'update' WHEN min(load_no) > 0 THEN 'insert' ELSE 'keep' END AS action FROM q GROUP BY 1")
def _(s, d):
    q = table(s, d, "candidates").select(F.explode("query_ids").alias("query_id"), "load_no").groupBy("query_id").agg(F.min("load_no").alias("lo"), F.max("load_no").alias("hi"))
    return q.select("query_id", F.when((F.col("lo") == 0) & (F.col("hi") > 0), "update").when(F.col("lo") > 0, "insert").otherwise("keep").alias("action"))


@query("ag19_feed_counts", "SELECT 'us' AS feed, count(DISTINCT field_recall_number) AS n FROM us_recall UNION ALL SELECT 'france', count(DISTINCT numero_fiche) FROM france_recall UNION ALL SELECT 'uk', count(DISTINCT notation) FROM uk_recall")
def _(s, d):
    one = lambda feed, n, k: table(s, d, n).agg(F.countDistinct(k).alias("n")).select(F.lit(feed).alias("feed"), "n")
    return one("us", "us_recall", "field_recall_number").unionByName(one("france", "france_recall", "numero_fiche")).unionByName(one("uk", "uk_recall", "notation"))


@query("so10_candidate_budget", f"WITH {C} SELECT candidate_id FROM c WHERE decision = 'accept' ORDER BY first_seen_at, candidate_id LIMIT 200")
def _(s, d):
    """The budget of a run: at most 200 accepted candidates, the oldest first."""
    return t.candidates(s, d).filter("decision = 'accept'").orderBy("first_seen_at", "candidate_id").limit(200).select("candidate_id")


@query("so11_links_per_host", f"WITH {C}, x AS (SELECT DISTINCT lower(regexp_extract(canonical_url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, canonical_url AS url FROM c) SELECT host, url FROM x QUALIFY row_number() OVER (PARTITION BY host ORDER BY url) <= 25")
def _(s, d):
    """A listing gives at most 25 notices, each address once."""
    x = t.candidates(s, d).select(urls.host(F.col("canonical_url")).alias("host"), F.col("canonical_url").alias("url")).distinct()
    return x.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("url"))).filter("n <= 25").select("host", "url")
