"""Queries on records delivered as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackwater.functions import dates
from brackwater.operators import payloads
from brackwater.plans.serving import A
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


_TREE = r"""u AS (SELECT DISTINCT notation, payload FROM uk_recall WHERE json_valid(payload)),
t AS (SELECT notation AS rec_id, id::bigint AS place, replace(fullkey[3:], '"', '') AS path, atom->>'$' AS value FROM u, json_tree(u.payload) WHERE type = 'VARCHAR' AND trim(atom->>'$', e' \t\n\r') <> '')"""


def _points(points) -> str:
    each = " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(path), '{w}')" for w in words) + f" THEN {n} ELSE 0 END" for words, n in points)
    return f"({each})"


def leaves(s, d):
    return payloads.text_leaves(table(s, d, "uk_recall"), "notation", "payload")


@query("js02_text_leaves", f"WITH {_TREE} SELECT rec_id, path, value FROM t")
def _(s, d):
    return leaves(s, d).select("rec_id", "path", "value")


@query("js01_shapes")
def _(s, d):
    """How many items of the feed share each structure."""
    return payloads.shapes(table(s, d, "uk_recall"), "notation", "payload").groupBy("shape").agg(F.countDistinct("rec_id").alias("items"))


@query("js03_tolerant_objects", "SELECT DISTINCT event_id::varchar AS rec_id, props AS document_in FROM events WHERE props IS NOT NULL")
def _(s, d):
    """The object of a reply that has words around it; here the details of a run's events."""
    wrapped = t.events(s, d).filter("props IS NOT NULL").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("Here it is: {not} "), "props", F.lit(" done")).alias("reply"))
    found = payloads.tolerant_objects(wrapped, "id", "reply")
    return found.select("rec_id", F.regexp_replace("document", r'":', '": ').alias("document_in"))


@query("wn10_best_address", f"WITH {_TREE}, c AS (SELECT *, {_points(payloads.URL_POINTS)} AS score FROM t WHERE regexp_matches(lower(trim(value)), '^https?://')) SELECT rec_id, arg_max(value, row(score, -place)) AS value, max(score)::bigint AS score FROM c GROUP BY rec_id")
def _(s, d):
    return payloads.best_address(leaves(s, d)).select("rec_id", "value", F.col("score").cast("bigint").alias("score"))


@query("wn09_best_name", f"WITH {_TREE}, c AS (SELECT *, {_points(payloads.NAME_POINTS)} - greatest(length(value) - 180, 0) AS score FROM t WHERE NOT regexp_matches(lower(trim(value)), '^https?://')) SELECT rec_id, arg_max(value, row(score, -place)) AS value, max(score)::bigint AS score FROM c GROUP BY rec_id")
def _(s, d):
    return payloads.best_name(leaves(s, d)).select("rec_id", "value", F.col("score").cast("bigint").alias("score"))


@query("wn11_best_date", f"WITH {_TREE}, c AS (SELECT *, {_points(payloads.DATE_POINTS)} AS score FROM t WHERE regexp_matches(trim(value), '^[0-9]{{4}}-') AND try_strptime(trim(value)[1:10], '%Y-%m-%d') IS NOT NULL) SELECT rec_id, arg_max(value, row(score, -place)) AS value, max(score)::bigint AS score FROM c GROUP BY rec_id")
def _(s, d):
    dated = leaves(s, d).filter(dates.safe_date(F.col("value")).isNotNull())
    best = payloads.best_leaf(dated, payloads.path_points(F.col("path"), payloads.DATE_POINTS))
    return best.select("rec_id", "value", F.col("score").cast("bigint").alias("score"))


@query("js06_exact_original", f"WITH {_TREE}, n AS (SELECT rec_id, arg_max(value, row({_points(payloads.NAME_POINTS)} - greatest(length(value) - 180, 0), -place)) AS wanted FROM t WHERE NOT regexp_matches(lower(trim(value)), '^https?://') GROUP BY rec_id) SELECT t.rec_id, arg_min(t.path, t.place) AS path FROM t JOIN n ON n.rec_id = t.rec_id AND trim(regexp_replace(t.value, '\\s+', ' ', 'g')) = trim(regexp_replace(n.wanted, '\\s+', ' ', 'g')) GROUP BY t.rec_id")
def _(s, d):
    """The first leaf whose cleaned text equals the cleaned name that a model gave back; here the best name."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    every = leaves(s, d)
    wanted = payloads.best_name(every).select("rec_id", tidy(F.col("value")).alias("wanted"))
    met = every.join(wanted, "rec_id").filter(tidy(F.col("value")) == F.col("wanted"))
    return met.groupBy("rec_id").agg(F.min_by("path", "place").alias("path"))


@query("js08_fallback_records", f"WITH {_TREE}, k AS (SELECT DISTINCT notation AS rec_id FROM u), n AS (SELECT rec_id, arg_max(value, row({_points(payloads.NAME_POINTS)} - greatest(length(value) - 180, 0), -place)) AS name FROM t WHERE NOT regexp_matches(lower(trim(value)), '^https?://') GROUP BY rec_id), a AS (SELECT rec_id, arg_max(value, row({_points(payloads.URL_POINTS)}, -place)) AS url FROM t WHERE regexp_matches(lower(trim(value)), '^https?://') GROUP BY rec_id) SELECT k.rec_id, coalesce(name, '') AS product_name, coalesce(url, '') AS source_url, 'Unknown' AS hazard_type, 'Other' AS product_category FROM k LEFT JOIN n ON n.rec_id = k.rec_id LEFT JOIN a ON a.rec_id = k.rec_id")
def _(s, d):
    every = leaves(s, d)
    ids = payloads.shapes(table(s, d, "uk_recall"), "notation", "payload").select("rec_id").distinct()
    name = payloads.best_name(every).select("rec_id", F.col("value").alias("name"))
    url = payloads.best_address(every).select("rec_id", F.col("value").alias("url"))
    d_ = payloads.DEFAULTS
    return ids.join(name, "rec_id", "left").join(url, "rec_id", "left").select(
        "rec_id", F.coalesce("name", F.lit("")).alias("product_name"), F.coalesce("url", F.lit("")).alias("source_url"),
        F.lit(d_["hazard_type"]).alias("hazard_type"), F.lit(d_["product_category"]).alias("product_category"),
    )


_ROW = payloads.REQUIRED
#: Fields that must hold text before a record becomes an alert.
_TEXTS = ("web_source", "country_source", "product_name", "recall_reason", "summary", "hazard_type", "consumer_action", "source_url")


@query("se04_missing_fields", f"WITH {A}, m AS (SELECT alert_id, [{', '.join(f'''CASE WHEN {c} IS NULL THEN '{c}' END''' for c in sorted(_ROW))}] AS l FROM a) SELECT alert_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS missing FROM m WHERE len(list_filter(l, lambda x: x IS NOT NULL)) > 0")
def _(s, d):
    stated = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in _ROW)))
    return t.alerts(s, d).select("alert_id", payloads.missing_fields(stated).alias("m")).filter(F.size("m") > 0).select("alert_id", F.array_join("m", ",").alias("missing"))


@query("js05_converted", f"WITH {A} SELECT alert_id, trim(product_name) AS product_name, coalesce(nullif(trim(product_category), ''), 'Other') AS product_category, coalesce(nullif(trim(risk_level), ''), 'Unknown') AS risk_level, strftime(recall_date, '%Y-%m-%d') AS recall_date FROM a WHERE trim(product_name) <> '' AND trim(recall_reason) <> '' AND trim(summary) <> '' AND trim(hazard_type) <> '' AND trim(consumer_action) <> '' AND trim(source_url) <> '' AND trim(country_source) <> '' AND trim(web_source) <> '' AND recall_date IS NOT NULL AND affected_regions IS NOT NULL")
def _(s, d):
    """Records with all required fields, blanks of optional ones filled."""
    a = t.alerts(s, d)
    for c in _TEXTS:
        a = a.filter(F.trim(c) != "")
    a = a.filter("recall_date IS NOT NULL AND affected_regions IS NOT NULL")
    fill = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(payloads.DEFAULTS[c])).alias(c)
    return a.select("alert_id", F.trim("product_name").alias("product_name"), fill("product_category"), fill("risk_level"), F.date_format("recall_date", "yyyy-MM-dd").alias("recall_date"))


@query("jn21_addresses_in_records", f"WITH {_TREE} SELECT rec_id, count(DISTINCT value)::bigint AS addresses FROM t WHERE regexp_matches(lower(trim(value)), '^https?://') GROUP BY rec_id")
def _(s, d):
    """The addresses that stand in a record: one that a model gives back must be among them."""
    return leaves(s, d).filter(payloads.is_address(F.col("value"))).groupBy("rec_id").agg(F.countDistinct("value").alias("addresses"))


#: Other names, in order, under which models write the kind of content.
KIND_NAMES = ("type", "classification", "category", "label")


@query("js04_content_type", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'given' ELSE NULL END AS content_type FROM events")
def _(s, d):
    """The kind of content under its own name, else under the first other name that a reply has.

    The replies are built from the run log: one names it ``type``, one gives both, one has neither.
    """
    e = t.events(s, d)
    reply = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("label"), F.lit("late"), F.lit("type"), "event_type")).when(
        F.col("event_id") % 3 == 1, F.create_map(F.lit("type"), "event_type", F.lit("content_type"), F.lit("given"))
    ).otherwise(F.create_map(F.lit("other"), "event_type"))
    named = F.coalesce(*(F.try_element_at("reply", F.lit(k)) for k in ("content_type", *KIND_NAMES)))
    return e.select("event_id", reply.alias("reply")).select("event_id", named.alias("content_type"))


@query("sc17_search_results", f"WITH c AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY last_seen_at DESC, attempt_count DESC) = 1) SELECT candidate_id AS rec_id, 1 AS rank, trim(title) AS title, trim(canonical_url) AS url FROM c WHERE trim(coalesce(title, '')) <> '' AND trim(coalesce(canonical_url, '')) <> ''")
def _(s, d):
    """Search replies as rows; here each candidate as the reply that brought it."""
    c = t.candidates(s, d).select("candidate_id", F.to_json(F.struct(F.struct(F.array(F.struct("title", F.col("canonical_url").alias("url"))).alias("results")).alias("web"))).alias("reply"))
    return payloads.search_results(c, "candidate_id", "reply").select("rec_id", "rank", "title", "url")
