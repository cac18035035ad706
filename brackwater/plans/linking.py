"""Queries of scalar functions, record linkage, neighbours, and the search catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brackwater.functions import ids, text, urls
from brackwater.operators import instants, linkage, searches, semantic
from brackwater.plans.serving import A, C, I
from brackwater.runtime import durable, table
from brackwater.sources import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("tx02_title_fingerprint", f"WITH {C}, n AS (SELECT candidate_id, array_to_string(regexp_extract_all(replace(lower(strip_accents(replace(coalesce(title, ''), '&', ' and '))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS k FROM c) SELECT candidate_id, CASE WHEN k <> '' THEN sha256(k) ELSE '' END AS fingerprint FROM n")
def _(s, d):
    n = text.folded(F.col("title"))
    return t.candidates(s, d).select("candidate_id", F.when(n != "", F.sha2(n, 256)).otherwise("").alias("fingerprint"))


_CLEAN = "x"
for _a, _b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&rsquo;", "’"), ("&eacute;", "é"), ("&nbsp;", " "), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"


@query("tx03_clean_text", f"SELECT field_recall_number, md5(trim(regexp_replace(regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g'), '[\\s\u00a0]+', ' ', 'g'))) AS body FROM (SELECT DISTINCT field_recall_number, field_press_release AS x FROM us_recall)")
def _(s, d):
    u = table(s, d, "us_recall").select("field_recall_number", "field_press_release").distinct()
    return u.select("field_recall_number", F.md5(text.strip_markup(F.col("field_press_release"))).alias("body"))


@query("tx05_split_lists", "SELECT DISTINCT numero_fiche, array_to_string(list_filter(list_transform(string_split(replace(distributeurs, '¤', '|'), '|'), lambda x: trim(x)), lambda x: x <> ''), '; ') AS items FROM france_recall WHERE distributeurs IS NOT NULL")
def _(s, d):
    f = table(s, d, "france_recall").select("numero_fiche", "distributeurs").filter("distributeurs IS NOT NULL").distinct()
    return f.select("numero_fiche", F.array_join(text.split_list(F.col("distributeurs")), "; ").alias("items"))


@query("tx06_without_boilerplate", f"WITH {A} SELECT alert_id, md5(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(summary, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '. '), lambda x: NOT regexp_matches(lower(x), '{'|'.join(text.BOILERPLATE)}')), '. ')) AS body FROM a")
def _(s, d):
    return t.alerts(s, d).select("alert_id", F.md5(text.without_boilerplate(F.col("summary"))).alias("body"))


@query("tx11_truncated", "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN rtrim(text[1:3999], ' ') || '…' ELSE text END) AS body FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.truncated(F.col("text"))).alias("body"))


@query("tx12_sentences", f"WITH {A} SELECT alert_id, len(list_filter(string_split(regexp_replace(trim(summary), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::bigint AS n FROM a")
def _(s, d):
    return t.alerts(s, d).select("alert_id", text.sentence_count(F.col("summary")).cast("bigint").alias("n"))


@query("tx18_confidence_label", f"WITH {I} SELECT incident_id, CASE WHEN confidence_score >= 85 THEN 'very high' WHEN confidence_score >= 70 THEN 'high' WHEN confidence_score >= 50 THEN 'medium' ELSE 'low' END AS label FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", text.confidence_label(F.col("confidence_score")).alias("label"))


@query("tx20_language_code", "SELECT doc_id, CASE WHEN regexp_matches(replace(lower(trim(lang)), '_', '-'), '^[a-z]{2}(-|$)') THEN lower(trim(lang))[1:2] WHEN lang IS NULL THEN NULL ELSE '' END AS code FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.language_code(F.col("lang")).alias("code"))


_PARTS = r"lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH, _QUERY = r"regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)", r"regexp_extract(u, '^[^?#]*\?([^#]*)', 1)"


_PAIRS = "list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: [url_decode(split_part(x, '=', 1)), url_decode(CASE WHEN contains(x, '=') THEN x[strpos(x, '=') + 1:] ELSE '' END)])"
_WRITTEN = "array_to_string(list_transform({}, lambda kv: url_encode(kv[1]) || '=' || url_encode(kv[2])), '&')"


@query("ur02_lenient_url", f"""WITH {A}, x AS (SELECT alert_id, trim(source_url) AS u FROM a WHERE source_url IS NOT NULL), p AS (SELECT alert_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, {_PATH} AS p, {_QUERY} AS q FROM x),
f AS (SELECT alert_id, s, h, p, {_WRITTEN.format(f"list_sort(list_filter({_PAIRS}, lambda kv: lower(kv[1]) NOT IN ({', '.join(map(repr, urls.LENIENT_KEYS))})))")} AS q FROM p)
SELECT alert_id, s || '://' || CASE WHEN s = 'https' AND ends_with(h, ':443') THEN h[:-5] WHEN s = 'http' AND ends_with(h, ':80') THEN h[:-4] ELSE h END
|| coalesce(nullif(rtrim(regexp_replace(p, '/{{2,}}', '/', 'g'), '/'), ''), '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM f""")
def _(s, d):
    return t.alerts(s, d, "source_url IS NOT NULL").select("alert_id", urls.canonical(F.col("source_url")).alias("url"))


@query("ur03_scraper_url", f"""WITH {A}, x AS (SELECT alert_id, source_url AS u FROM a WHERE source_url IS NOT NULL), p AS (SELECT alert_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h, {_PATH} AS p, {_QUERY} AS q FROM x),
f AS (SELECT alert_id, s, h, p, {_WRITTEN.format(f"list_filter({_PAIRS}, lambda kv: NOT regexp_matches(lower(kv[1]), '^({'|'.join(urls.SCRAPER_PREFIXES)})'))")} AS q FROM p)
SELECT alert_id, s || '://' || h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM f""")
def _(s, d):
    return t.alerts(s, d, "source_url IS NOT NULL").select("alert_id", urls.scraper(F.col("source_url")).alias("url"))


@query("ur01_strict_url")
def _(s, d):
    return t.alerts(s, d).select("alert_id", urls.strict(F.col("source_url")).alias("url"))


@query("ur04_collapsed_segments")
def _(s, d):
    return t.alerts(s, d).select("alert_id", urls.collapsed_segments(urls.path(F.col("source_url"))).alias("path"))


@query("ur05_joined_link", f"SELECT DISTINCT source_name, regexp_replace(homepage_url, '/+$', '') || '/recalls/today' AS url FROM sources")
def _(s, d):
    joined = F.concat(urls.base(F.col("homepage_url")), urls.collapsed_segments(F.concat(urls.path(F.col("homepage_url")), F.lit("/recalls/today"))))
    return t.sources(s, d).select("source_name", joined.alias("url"))


@query("ur06_base_url", "SELECT DISTINCT source_name, lower(regexp_extract(homepage_url, '^([A-Za-z]+://[^/?#]+)', 1)) AS base FROM sources")
def _(s, d):
    return t.sources(s, d).select("source_name", urls.base(F.col("homepage_url")).alias("base"))


@query("ur06_domains", "SELECT DISTINCT source_name, array_to_string([h, 'www.' || h], ',') AS domains FROM (SELECT source_name, regexp_replace(lower(regexp_extract(homepage_url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h FROM sources)")
def _(s, d):
    return t.sources(s, d).select("source_name", F.array_join(urls.domains(F.col("homepage_url")), ",").alias("domains"))


@query("ur07_path_parts", f"WITH {A} SELECT alert_id, array_to_string(list_filter(string_split(lower({_PATH.replace('u,', 'source_url,')}), '/'), lambda x: x <> ''), '|') AS parts FROM a")
def _(s, d):
    return t.alerts(s, d).select("alert_id", F.array_join(urls.path_parts(F.col("source_url")), "|").alias("parts"))


@query("hs02_stable_id", f"WITH {C} SELECT candidate_id, sha256(concat_ws(chr(0), trim(coalesce(title, '')), trim(coalesce(country, '')), trim(coalesce(language, '')))) AS key FROM c")
def _(s, d):
    return t.candidates(s, d).select("candidate_id", ids.nul_hash(F.trim("title"), F.trim("country"), F.trim("language")).alias("key"))


#: Fixed value: the namespace of incident ids.
INCIDENT_NAMESPACE = uuid.UUID("257e537e-d840-531f-aec4-5ca8f741fd37")


@query("hs04_uuid5", f"WITH {I}, x AS (SELECT incident_id, sha1(from_hex('{INCIDENT_NAMESPACE.hex}') || encode(coalesce(cluster_fingerprint, ''))) AS h FROM i) SELECT incident_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM x")
def _(s, d):
    return t.incidents(s, d).select("incident_id", ids.uuid5(F.coalesce("cluster_fingerprint", F.lit("")), INCIDENT_NAMESPACE).alias("uuid"))


@query("hs05_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def _smallest(name: str, spark_key, sql_key: str) -> None:
    sql = f"WITH {I}, k AS (SELECT DISTINCT incident_id AS id, {sql_key} AS key FROM (SELECT incident_id, product_name, unnest(evidence) AS e FROM i)) SELECT a.id, min(b.id) AS other_id FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id WHERE a.key <> '' GROUP BY a.id"

    @query(name, sql)
    def _(s, d):
        rows = t.incidents(s, d).select(F.col("incident_id").alias("id"), F.explode("evidence").alias("e")).select("id", spark_key(F.col("e")).alias("key"))
        return linkage.smallest_partner(rows)


_smallest("jn02_same_url", lambda e: F.lower(F.trim(e["url"])), "lower(trim(e.url))")
_smallest("jn03_same_content_hash", lambda e: e["content_hash"], "e.content_hash")


def incident_urls(s, d):
    """(id, key): primary, evidence and alias addresses of the incidents in the form in which they are compared."""
    none = F.array().cast("array<string>")
    each = F.flatten(F.transform(F.coalesce("evidence", F.array().cast(t.incidents(s, d).schema["evidence"].dataType)), lambda e: F.concat(F.array(e["url"]), F.coalesce(e["redirected_url_aliases"], none))))
    held = t.incidents(s, d).select(F.col("incident_id").alias("id"), F.explode(F.concat(F.array("primary_source_url"), F.coalesce(F.array_compact(each), none))).alias("u")).distinct()
    return held.select("id", urls.canonical(F.col("u")).alias("key"))


def _evidence(s, d):
    return t.incidents(s, d).select(F.col("incident_id").alias("id"), F.explode("evidence").alias("e"))


@query("jn02_url_classes")
def _(s, d):
    return linkage.link_classes(incident_urls(s, d))


@query("jn03_hash_classes", f"WITH {I}, k AS (SELECT DISTINCT incident_id AS id, lower(trim(e.content_hash, e' \\t\\n\\r\\v\\f')) AS key FROM (SELECT incident_id, unnest(evidence) AS e FROM i)) SELECT id, key, min(id) OVER w AS class_id, count(*) OVER w - 1 AS links FROM k WHERE key <> '' WINDOW w AS (PARTITION BY key) QUALIFY links > 0")
def _(s, d):
    trimmed = F.regexp_replace(F.col("e.content_hash"), r"^\s+|\s+$", "")
    return linkage.link_classes(_evidence(s, d).select("id", F.lower(trimmed).alias("key")))


@query("jn04_title_classes")
def _(s, d):
    named = _evidence(s, d).select("id", text.folded(F.col("e.title")).alias("title"))
    return linkage.link_classes(named.select("id", F.when(F.col("title") != "", F.sha2("title", 256)).alias("key")))


_TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')))"


@query("jn05_entity_date", f"""WITH {I}, x AS (SELECT incident_id AS id, {_TOKENS.format('product_name')} AS p, {_TOKENS.format('company_name')} AS c, CAST(first_discovered_at AS date) AS day FROM i),
m AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.id <> b.id AND len(a.p) >= 2 AND len(b.p) >= len(a.p) AND list_has_all(b.p, a.p) AND len(a.c) >= 2 AND a.c = b.c AND abs(date_diff('day', a.day, b.day)) <= 7)
SELECT id, min(other) AS other_id FROM (SELECT a AS id, b AS other FROM m UNION ALL SELECT b, a FROM m) GROUP BY id""")
def _(s, d):
    tokens = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")))
    x = t.incidents(s, d).select(F.col("incident_id").alias("id"), tokens(F.col("product_name")).alias("p"), tokens(F.col("company_name")).alias("c"), F.to_date("first_discovered_at").alias("day"))
    x = x.filter((F.size("p") >= 2) & (F.size("c") >= 2))
    block = F.floor(F.unix_date("day") / 8)
    left = x.select(F.col("id").alias("a"), F.col("p").alias("ap"), "c", F.col("day").alias("ad"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = x.select(F.col("id").alias("b"), F.col("p").alias("bp"), "c", F.col("day").alias("bd"), block.alias("block"))
    inside = (F.size("ap") <= F.size("bp")) & (F.size(F.array_except("ap", "bp")) == 0)
    m = left.join(right, ["c", "block"]).filter((F.col("a") != F.col("b")) & linkage.within_days(F.col("ad"), F.col("bd")) & inside).select("a", "b")
    both = m.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(m.select(F.col("b").alias("id"), F.col("a").alias("other")))
    return both.groupBy("id").agg(F.min("other").alias("other_id"))


#: A zone after a clock; the civil day of a written time is that of its own zone.
_ZONE = r"(?<=\d|[AaPp]\.?[Mm]\.?)\s*(?:Z|(?![AP]M)[A-Z]{2,4}|[+-]\d{2}:?\d{2}|[+-]\d{2})$"


def incident_entities(s, d):
    """(id, product, company, hazard, day): folded names and the civil day of publication, null if none is written."""
    w = F.trim("publication_date")
    bare = F.when(w.rlike(r"\d[:h]\d{2}|\dT\d{4}"), F.regexp_replace(w, _ZONE, "")).otherwise(w)
    x = t.incidents(s, d).select(
        F.col("incident_id").alias("id"), *(text.folded(F.col(c)).alias(n) for c, n in (("product_name", "product"), ("company_name", "company"), ("hazard_type", "hazard"))),
        F.coalesce("hazard_type", F.lit("")).alias("hazard_raw"), bare.alias("w"),
    )
    read = instants.with_epoch_seconds(x, "w", "sec", "UTC").withColumn("day", F.date_from_unix_date(F.floor(F.col("sec") / 86400).cast("int")))
    return durable(read.drop("w", "sec"))


@query("jn05_entity_links")
def _(s, d):
    pairs = linkage.entity_date_pairs(incident_entities(s, d).drop("hazard_raw"))
    first = F.min(F.struct("other_id", "overlap"))
    return pairs.groupBy("id").agg(first.alias("m"), F.count("*").alias("links")).select("id", "m.other_id", "m.overlap", "links")


@query("jn08_official_link")
def _(s, d):
    a = t.alerts(s, d).select("alert_id", urls.canonical(F.col("source_url")).alias("key"), text.folded(F.col("product_name")).alias("product"), text.folded(F.col("hazard_type")).alias("a_hazard"), F.coalesce("hazard_type", F.lit("")).alias("a_raw"), "recall_date")
    a = durable(a)
    held = incident_urls(s, d).filter("key <> ''").join(a.select("alert_id", "key"), "key")
    by_url = held.select(F.col("id").alias("incident_id"), "alert_id", F.lit(0).alias("rank"), F.lit("").alias("overlap"))
    at = F.floor(F.unix_date("day") / 8)
    i = incident_entities(s, d).filter("day IS NOT NULL").withColumn("block", F.explode(F.array(at - 1, at, at + 1)))
    met = i.join(a.filter("recall_date IS NOT NULL").withColumn("block", F.floor(F.unix_date("recall_date") / 8)), ["product", "block"])
    stated = (F.col("hazard_raw") != "") & (F.col("a_raw") != "")
    met = met.filter(linkage.within_days(F.col("day"), F.col("recall_date")) & (~stated | (F.col("hazard") == F.col("a_hazard"))))
    by_name = met.select(F.col("id").alias("incident_id"), "alert_id", F.lit(1).alias("rank"), F.concat(F.lit("product,date"), F.when(stated, ",hazard").otherwise("")).alias("overlap"))
    best = by_url.unionByName(by_name).groupBy("incident_id").agg(F.min(F.struct("rank", "alert_id", "overlap")).alias("m"))
    return best.select("incident_id", "m.alert_id", F.when(F.col("m.rank") == 0, "exact_url").otherwise("entity_date").alias("kind"), "m.overlap")


@query("jn08_official_match", f"WITH {A}, {I} SELECT i.incident_id, min(a.alert_id) AS alert_id FROM i JOIN a ON lower(trim(i.product_name)) = lower(trim(a.product_name)) AND trim(i.product_name) <> '' AND abs(date_diff('day', CAST(i.first_discovered_at AS date), a.recall_date)) <= 365 GROUP BY 1")
def _(s, d):
    i = t.incidents(s, d).select("incident_id", F.lower(F.trim("product_name")).alias("k"), F.to_date("first_discovered_at").alias("day")).filter("k <> ''")
    block = lambda c: F.floor(F.unix_date(c) / 366)
    a = t.alerts(s, d).select("alert_id", F.lower(F.trim("product_name")).alias("k"), "recall_date", block("recall_date").alias("block"))
    near = i.withColumn("block", F.explode(F.array(block("day") - 1, block("day"), block("day") + 1)))
    return near.join(a, ["k", "block"]).filter(linkage.within_days(F.col("day"), F.col("recall_date"), 365)).groupBy("incident_id").agg(F.min("alert_id").alias("alert_id"))


@query("jn11_domain_profile", f"WITH {C}, h AS (SELECT DISTINCT lower(regexp_extract(canonical_url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM c), p AS (SELECT DISTINCT unnest(allowed_domains) AS domain FROM sources) SELECT host, arg_max(domain, length(domain)) AS domain FROM h JOIN p ON host = domain OR ends_with(host, '.' || domain) GROUP BY host")
def _(s, d):
    hosts = t.candidates(s, d).select(urls.host(F.col("canonical_url")).alias("host"))
    return linkage.longest_suffix(hosts, t.sources(s, d).select(F.explode("allowed_domains").alias("domain")))


@query("jn14_nearest", "SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::double[], x.embedding::double[]) DESC, x.vec_id)::int AS rank FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10")
def _(s, d):
    e = table(s, d, "embeddings")
    return semantic.nearest(e.filter("vec_id % 20 = 0"), e, 10)


@query("jn16_country_of_source", f"WITH {A} SELECT alert_id, coalesce(nullif(country_source, ''), s.c, 'unknown') AS country FROM a LEFT JOIN (SELECT source_name, min(country_source) AS c FROM sources GROUP BY 1) s ON s.source_name = a.web_source")
def _(s, d):
    named = t.sources(s, d).select(F.col("source_name").alias("web_source"), F.col("country_source").alias("_c"))
    return t.alerts(s, d).join(named, "web_source", "left").select("alert_id", F.coalesce(F.nullif("country_source", F.lit("")), "_c", F.lit("unknown")).alias("country"))


@query("se01_ordered_union", f"WITH {I}, u AS (SELECT incident_id, coalesce(confidence_reasons, []) || coalesce(processing_errors, []) AS l FROM i) SELECT incident_id, array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), ';') AS items FROM u")
def _(s, d):
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("confidence_reasons", none), F.coalesce("processing_errors", none)))
    return t.incidents(s, d).select("incident_id", F.array_join(F.array_compact(both), ";").alias("items"))


def _text(x) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


_DIMS = ", ".join(f"({i}, {_text(c)}, {_text(n)}, {_list((n, *a))}, {_text(g)}, {_list(ds)}, {_list(searches.TERMS[g][0])}, {_list(searches.TERMS[g][1])})" for i, (c, n, a, g, ds) in enumerate(searches.COUNTRIES))
_CATALOGUE = f"""dims(c_pos, country, name, names, language, domains, recall, more) AS (VALUES {_DIMS}),
each AS (SELECT c_pos, country, language, NULL AS domain, recall[t] || ' ' || names[n] AS text, [0, n, t] AS o FROM (SELECT *, unnest(range(1, len(recall) + 1)) AS t FROM (SELECT *, unnest(range(1, len(names) + 1)) AS n FROM dims))
  UNION ALL SELECT c_pos, country, language, NULL, more[t] || ' ' || name, [1, t, 0] FROM (SELECT *, unnest(range(1, len(more) + 1)) AS t FROM dims)
  UNION ALL SELECT c_pos, country, language, domains[n], recall[t] || ' site:' || domains[n], [2, n, t] FROM (SELECT *, unnest([1, 2]) AS t FROM (SELECT *, unnest(range(1, len(domains) + 1)) AS n FROM dims))),
once AS (SELECT c_pos, country, language, domain, text, min(o) AS o FROM each GROUP BY ALL), turn AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY o) AS turn FROM once),
catalogue AS (SELECT row_number() OVER (ORDER BY turn, c_pos) - 1 AS pos, country, language, domain, text FROM turn)"""


@query("sc25_query_catalogue", f"WITH {_CATALOGUE} SELECT pos::int AS pos, country, language, domain, text FROM catalogue")
def _(s, d):
    return searches.catalogue(s)


@query("wn02_query_rotation", f"WITH {_CATALOGUE}, n AS (SELECT count(*) AS total FROM catalogue), x AS (SELECT ((pos - least(12, total)) % total + total) % total AS slot, country, text FROM catalogue, n) SELECT slot, country, text FROM x WHERE slot < 12")
def _(s, d):
    return searches.rotated(searches.catalogue(s), 1, 12)
