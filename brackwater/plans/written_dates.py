"""Queries on dates written in texts and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from brackwater.functions import dates
from brackwater.plans.serving import AS_OF, I, day
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


def _quoted(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


_MONTHS = "map(" + _quoted(dates.MONTHS) + ", " + str([str(v) for v in dates.MONTHS.values()]) + ")"
_NAMED = dates.NAMED.replace("(?i)", "").replace("\\", "\\")
_REAL = "try_strptime(lpad({0}, 4, '0') || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0'), '%Y-%m-%d')::date"
_YEAR = "CASE WHEN length(p[3]) = 2 THEN '20' || p[3] WHEN length(p[3]) = 4 THEN p[3] END"


def _found(source: str, key: str, column: str, marked: bool, tag: str = "") -> str:
    """SQL of the dates that a column writes: (k, d) in ``kept``; ``tag`` tells two such parts of one query apart."""
    free = f"WHERE NOT list_has_any([true], list_transform({_quoted(dates.EXCLUDING)}, lambda m: contains(substr(x, greatest(1, strpos(x, lower(tok)) - 80), strpos(x, lower(tok)) - greatest(1, strpos(x, lower(tok)) - 80) + length(tok)), m)))" if marked else ""
    return rf"""
src{tag} AS (SELECT DISTINCT {key} AS k, {column} AS body, lower({column}) AS x FROM {source} WHERE {column} IS NOT NULL),
num{tag} AS (SELECT k, x, unnest(list_distinct(regexp_extract_all(body, '{dates.NUMERIC}', 1))) AS tok FROM src{tag}),
nam{tag} AS (SELECT k, x, unnest(list_distinct(regexp_extract_all(body, '{_NAMED}', 1, 'i'))) AS tok FROM src{tag}),
iso{tag} AS (SELECT k, x, unnest(list_distinct(regexp_extract_all(body, '{dates.ISO}', 1))) AS tok FROM src{tag}),
numf{tag} AS (SELECT k, regexp_split_to_array(tok, '[/.-]') AS p FROM num{tag} {free}),
namf{tag} AS (SELECT k, regexp_split_to_array(trim(tok), '\s+') AS p FROM nam{tag} {free}),
isof{tag} AS (SELECT k, tok FROM iso{tag} {free}),
found{tag} AS (SELECT k, {_REAL.format(_YEAR, 'p[2]', 'p[1]')} AS d FROM numf{tag} UNION SELECT k, {_REAL.format(_YEAR, 'p[1]', 'p[2]')} FROM numf{tag}
  UNION SELECT k, CASE WHEN length(p[1]) = 2 AND length(p[3]) = 2 THEN {_REAL.format("'20' || p[1]", 'p[2]', 'p[3]')} END FROM numf{tag}
  UNION SELECT k, {_REAL.format('p[3]', f"{_MONTHS}[replace(lower(p[2]), '.', '')]", 'p[1]')} FROM namf{tag}
  UNION SELECT k, try_strptime(tok, '%Y-%m-%d')::date FROM isof{tag}),
kept{tag} AS (SELECT DISTINCT k, d FROM found{tag} WHERE d BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}')"""


def _reference():
    return F.lit(AS_OF).cast("date")


def _each(df, key: str, found):
    return df.select(F.col(key).alias("k"), F.explode(found).alias("d")).select("k", day("d").alias("d")).distinct()


_LIST = "SELECT k, strftime(d, '%Y-%m-%d') AS d FROM kept"


@query("dt01_text_dates", f"WITH {_found('france_recall', 'numero_fiche', 'date_publication', False)} {_LIST}")
def _(s, d):
    return _each(table(s, d, "france_recall").filter("date_publication IS NOT NULL"), "numero_fiche", dates.text_dates(F.col("date_publication"), _reference()))


_NOTICE = "(SELECT field_recall_number, coalesce(field_recall_date, '') || repeat('.', 90) || ' last modified ' || coalesce(field_last_modified_date, '') AS body FROM us_recall)"


def notices(s, d):
    """(field_recall_number, body): the recall date as written and, marked as such, that of the last change."""
    both = F.concat(F.coalesce("field_recall_date", F.lit("")), F.lit("." * 90 + " last modified "), F.coalesce("field_last_modified_date", F.lit("")))
    return table(s, d, "us_recall").select("field_recall_number", both.alias("body"))


@query("dt01_notice_dates", f"WITH {_found(_NOTICE, 'field_recall_number', 'body', False)} {_LIST}")
def _(s, d):
    return _each(notices(s, d), "field_recall_number", dates.text_dates(F.col("body"), _reference()))


@query("dt04_publication_dates", f"WITH {_found(_NOTICE, 'field_recall_number', 'body', True)} {_LIST}")
def _(s, d):
    return _each(notices(s, d), "field_recall_number", dates.text_dates(F.col("body"), _reference(), dates.EXCLUDING))


@query("fl17_marked_dates", f"WITH {_found(_NOTICE, 'field_recall_number', 'body', True)}, {_found(_NOTICE, 'field_recall_number', 'body', False, '2')} SELECT k, strftime(d, '%Y-%m-%d') AS d FROM kept2 EXCEPT SELECT k, strftime(d, '%Y-%m-%d') FROM kept")
def _(s, d):
    """Dates that only stand beside a marker."""
    n = notices(s, d)
    every = _each(n, "field_recall_number", dates.text_dates(F.col("body"), _reference()))
    return every.join(_each(n, "field_recall_number", dates.text_dates(F.col("body"), _reference(), dates.EXCLUDING)), ["k", "d"], "left_anti")


@query("fl15_recent_notices", f"WITH {_found(_NOTICE, 'field_recall_number', 'body', True)} SELECT DISTINCT k FROM kept WHERE d >= DATE '{AS_OF}' - 1000")
def _(s, d):
    found = _each(notices(s, d), "field_recall_number", dates.text_dates(F.col("body"), _reference(), dates.EXCLUDING))
    return found.filter(F.col("d") >= F.date_sub(_reference(), 1000).cast("string")).select("k").distinct()


@query("dt03_structured_dates")
def _(s, d):
    """Unique dates of the written publication dates, in order."""
    found = dates.structured_dates(F.col("publication_date"), _reference())
    return t.incidents(s, d).select("incident_id", F.array_join(F.transform(found, day), ",").alias("days"))


@query("dt02_structured_date", f"WITH {I}, x AS (SELECT incident_id, trim(publication_date) AS w FROM i) SELECT incident_id, strftime(CASE WHEN regexp_matches(w, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN try_strptime(w[1:10], '%Y-%m-%d') WHEN regexp_matches(w, '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}$') THEN try_strptime(w, '%d.%m.%Y') END, '%Y-%m-%d') AS day FROM x WHERE regexp_matches(w, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') OR regexp_matches(w, '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}$')")
def _(s, d):
    w = F.trim("publication_date")
    x = t.incidents(s, d, w.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$") | w.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"))
    return x.select("incident_id", day(F.get(dates.structured_dates(F.col("publication_date"), F.lit("2100-01-01").cast("date")), F.lit(0))).alias("day"))


@query("dt08_tolerant_date", f"WITH {I} SELECT incident_id, strftime(coalesce(try_strptime(trim(publication_date)[1:10], '%Y-%m-%d'), CASE WHEN regexp_matches(trim(publication_date), '^[0-9]{{8}}($|T)') THEN try_strptime(trim(publication_date)[1:8], '%Y%m%d') END), '%Y-%m-%d') AS day FROM i")
def _(s, d):
    return t.incidents(s, d).select("incident_id", day(dates.tolerant_date(F.col("publication_date"))).alias("day"))


@query("dt09_within_window", f"WITH {I}, x AS (SELECT incident_id, try_strptime(trim(publication_date)[1:10], '%Y-%m-%d')::date AS p, first_discovered_at::date AS f FROM i) SELECT incident_id, coalesce(abs(date_diff('day', p, f)) <= 7, false) AS near FROM x")
def _(s, d):
    p = dates.safe_date(F.col("publication_date"))
    return t.incidents(s, d).select("incident_id", F.coalesce(F.abs(F.datediff(p, F.to_date("first_discovered_at"))) <= 7, F.lit(False)).alias("near"))


@query("dt10_complete", "SELECT DISTINCT numero_fiche, date_publication, coalesce(trim(date_publication) <> '' AND NOT regexp_matches(trim(date_publication), '[0-9]{4}\\s+[A-Za-zÀ-ÿ]') AND (regexp_matches(trim(date_publication), '^([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$') OR (regexp_matches(trim(date_publication), '[A-Za-zÀ-ÿ]{3,}') AND regexp_matches(trim(date_publication), '[0-9]{4}')) OR len(regexp_extract_all(trim(date_publication), '[0-9]+')) >= 3), false) AS complete FROM france_recall")
def _(s, d):
    return table(s, d, "france_recall").select("numero_fiche", "date_publication").distinct().select("numero_fiche", "date_publication", dates.complete_match(F.col("date_publication")).alias("complete"))


def dated_incidents(s, d):
    """(incident_id, found): the written date as structured, those in the summary as generic."""
    structured = F.transform(dates.structured_dates(F.col("publication_date"), _reference()), lambda x: F.struct(F.lit("structured").alias("source"), x.alias("day")))
    none = F.array().cast("array<struct<source:string,day:date>>")
    seen = F.transform(F.array(F.to_date("first_discovered_at")), lambda x: F.struct(F.lit("generic").alias("source"), x.alias("day")))
    return t.incidents(s, d).select("incident_id", F.concat(F.coalesce(structured, none), seen).alias("found"))


_ISO_ONLY = f"WITH {I}, x AS (SELECT incident_id, CASE WHEN regexp_matches(trim(publication_date), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN try_strptime(trim(publication_date)[1:10], '%Y-%m-%d')::date END AS p, first_discovered_at::date AS f FROM i WHERE regexp_matches(trim(publication_date), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$'))"


def _iso_only(s, d):
    return t.incidents(s, d, F.trim("publication_date").rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")).select("incident_id").join(dated_incidents(s, d), "incident_id")


@query("dt05_recent_date", f"{_ISO_ONLY} SELECT incident_id, strftime(CASE WHEN p BETWEEN DATE '{AS_OF}' - 400 AND DATE '{AS_OF}' THEN p WHEN f BETWEEN DATE '{AS_OF}' - 400 AND DATE '{AS_OF}' THEN f END, '%Y-%m-%d') AS day FROM x")
def _(s, d):
    return _iso_only(s, d).select("incident_id", day(dates.best_date(F.col("found"), _reference(), 400)["day"]).alias("day"))


@query("dt06_non_future_date", f"{_ISO_ONLY} SELECT incident_id, strftime(CASE WHEN p <= DATE '{AS_OF}' AND p >= DATE '1900-01-01' THEN p WHEN f <= DATE '{AS_OF}' THEN f END, '%Y-%m-%d') AS day FROM x")
def _(s, d):
    return _iso_only(s, d).select("incident_id", day(dates.best_date(F.col("found"), _reference())["day"]).alias("day"))


@query("dt07_preferred_date", f"{_ISO_ONLY} SELECT incident_id, strftime(coalesce(CASE WHEN p BETWEEN DATE '{AS_OF}' - 14 AND DATE '{AS_OF}' THEN p WHEN f BETWEEN DATE '{AS_OF}' - 14 AND DATE '{AS_OF}' THEN f END, CASE WHEN p <= DATE '{AS_OF}' AND p >= DATE '1900-01-01' THEN p WHEN f <= DATE '{AS_OF}' THEN f END), '%Y-%m-%d') AS day FROM x")
def _(s, d):
    near, any_ = dates.best_date(F.col("found"), _reference(), 14), dates.best_date(F.col("found"), _reference())
    return _iso_only(s, d).select("incident_id", day(F.coalesce(near["day"], any_["day"])).alias("day"))


@query("wn06_best_source", f"{_ISO_ONLY} SELECT incident_id, CASE WHEN p <= DATE '{AS_OF}' AND p >= DATE '1900-01-01' THEN 'structured' WHEN f <= DATE '{AS_OF}' THEN 'generic' END AS source FROM x")
def _(s, d):
    return _iso_only(s, d).select("incident_id", dates.best_date(F.col("found"), _reference())["source"].alias("source"))


@query("dt11_date_labels", f"{_ISO_ONLY}, l AS (SELECT incident_id, p AS d, 'structured' AS label, 0 AS r FROM x WHERE p BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}' UNION ALL SELECT incident_id, f, 'generic', 2 FROM x) SELECT incident_id, strftime(d, '%Y-%m-%d') AS day, arg_min(label, r) AS label FROM l GROUP BY incident_id, d")
def _(s, d):
    each = _iso_only(s, d).select("incident_id", F.posexplode("found").alias("i", "x")).select("incident_id", "i", "x.day", "x.source")
    return each.groupBy("incident_id", "day").agg(F.min_by("source", "i").alias("label")).select("incident_id", day("day").alias("day"), "label")


@query("se05_merged_dates", f"{_ISO_ONLY} SELECT incident_id, concat_ws(',', strftime(CASE WHEN p BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}' THEN p END, '%Y-%m-%d'), CASE WHEN f IS DISTINCT FROM CASE WHEN p BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}' THEN p END THEN strftime(f, '%Y-%m-%d') END) AS days FROM x")
def _(s, d):
    merged = F.array_distinct(F.transform("found", lambda x: day(x["day"])))
    return _iso_only(s, d).select("incident_id", F.array_join(merged, ",").alias("days"))


@query("dt12_to_next_run", "SELECT event_id, (epoch_us(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 3 HOUR + CASE WHEN time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 3 HOUR > ts THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END) - epoch_us(time_bucket(INTERVAL 1 SECOND, ts))) // 1000000 AS seconds FROM events")
def _(s, d):
    return t.events(s, d).select("event_id", dates.seconds_to(3, F.col("ts"), "UTC").alias("seconds"))


@query("dt15_retry_delay", "SELECT event_id, least(coalesce(nullif(try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint), 0), 1), 60) AS seconds FROM events")
def _(s, d):
    """The number in a reply's details as seconds to wait, at least one and at most sixty."""
    n = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint)")
    return t.events(s, d).select("event_id", F.least(F.coalesce(F.nullif(n, F.lit(0)), F.lit(1)), F.lit(60)).alias("seconds"))


@query("tx21_document_languages", "WITH s AS (SELECT source_name, any_value(date_languages) AS l FROM sources GROUP BY 1) SELECT DISTINCT d.doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(replace(lower(trim(d.lang)), '_', '-'), '^[a-z]{2}') AND NOT list_contains(coalesce(s.l, []), lower(trim(d.lang))[1:2]) THEN lower(trim(d.lang))[1:2] END] || coalesce(s.l, []), lambda x: x IS NOT NULL), ',') AS langs FROM documents d LEFT JOIN s ON s.source_name = d.source")
def _(s, d):
    """The document's own language first unless its source names it, then those of the source."""
    known = t.sources(s, d).select(F.col("source_name").alias("source"), "date_languages")
    own = F.nullif(F.regexp_extract(F.replace(F.lower(F.trim("lang")), F.lit("_"), F.lit("-")), "^[a-z]{2}", 0), F.lit(""))
    stated = F.coalesce("date_languages", F.array().cast("array<string>"))
    first = F.when(~F.array_contains(stated, own), own)
    docs = table(s, d, "documents").select("doc_id", "lang", "source").distinct().join(known, "source", "left")
    return docs.select("doc_id", F.array_join(F.array_compact(F.concat(F.array(first), stated)), ",").alias("langs"))
