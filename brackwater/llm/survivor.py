"""One surviving record for each group of duplicates, field by field.

Each field comes from the record that deserves most belief: by trust tier, then
completeness, then currency.  Where records of equal belief lack a time, currency
is reasoned about.  From the timed records the operator learns transitions: in a
group, the value of a field that was last seen before the next one votes that it
precedes that one.  The majority of votes over all groups is the precedence of
values.  Inside a group it orders the values that compete for a field (two timed
values are ordered by their times): a value that another one of the group
succeeds is outdated, and the survivor takes a value that none succeeds, the
topologically latest.

Precedence and group orders are tables, never collected; they are joined value by
value, so a group that holds a third of all rows makes no pairs of its rows.
Counts, bests and spans are partial aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.runtime import table

#: Tiers from most to least trusted.
TIERS = ("official", "high", "medium", "low", "unknown")
#: Words and marks that stand for no value.
NO_VALUE = (
    "unknown", "n/a", "na", "n.a.", "tbd", "tbc", "null", "none", "nil", "nan", "not stated", "not available",
    "not specified", "not applicable", "unspecified", "undefined", "missing", "-", "--", "---", "?", "??", "???",
    ".", "..", "...", "*", "/", "_", "–", "—", "#n/a", "(none)", "(unknown)",
)
FIELDS = ("product_name", "company_name", "hazard_type", "country", "consumer_guidance")


def usable(c: Column) -> Column:
    """Not null, blank, or a word or mark that stands for no value."""
    tidy = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return c.isNotNull() & (tidy != "") & ~tidy.isin(*NO_VALUE)


def _tier(c: Column) -> Column:
    tidy = F.lower(F.trim(c))
    return reduce(lambda w, x: w.when(tidy == x[1], len(TIERS) - x[0]), enumerate(TIERS[:-1]), F.when(F.lit(False), 0)).otherwise(1)


def _key(df: DataFrame) -> DataFrame:
    """``df`` with its fingerprint as ``_key``, rows without one or without an id left out."""
    key = F.lower(F.trim(F.regexp_replace("cluster_fingerprint", r"^\s+|\s+$", "")))
    return df.filter(F.col("incident_id").isNotNull()).withColumn("_key", key).filter(F.col("_key") != "")


def field_values(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(_key, field, value, raw, tier, share, time, id): every usable value; ``value`` is written in one way."""
    share = F.col("extraction_completeness")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(usable(F.col(f)), F.col(f).cast("string")).alias("raw")) for f in fields)))
    return (
        rows.select(
            "_key", pairs.alias("x"), (-_tier(F.col("trust_tier"))).alias("tier"),
            F.coalesce(-F.when(share > 1, share / 100).otherwise(share), F.lit(2.0)).alias("share"),
            F.unix_micros("last_discovered_at").alias("time"), F.col("incident_id").alias("id"),
        )
        .filter("x.raw IS NOT NULL")
        .select("_key", "x.field", F.lower(F.trim(F.regexp_replace("x.raw", r"\s+", " "))).alias("value"), "x.raw", "tier", "share", "time", "id")
    )


def learn_precedence(values: DataFrame) -> DataFrame:
    """(field, before, after): more groups show a transition from ``before`` to ``after`` than the other way.

    A transition leads from a value to the one that is last seen next in its
    group, at a later time.  Only a group's distinct values are ordered, after
    their spans are aggregated.
    """
    spans = values.filter("time IS NOT NULL").groupBy("_key", "field", "value").agg(F.max("time").alias("last"))
    order = Window.partitionBy("_key", "field").orderBy("last", "value")
    steps = spans.select("field", "value", "last", F.lead("value").over(order).alias("next"), F.lead("last").over(order).alias("next_last")).filter("next_last > last")
    up = F.col("value") < F.col("next")
    votes = steps.groupBy("field", F.least("value", "next").alias("a"), F.greatest("value", "next").alias("b")).agg(F.sum(F.when(up, 1).otherwise(-1)).alias("net"))
    return votes.filter("net <> 0").select(
        "field", F.when(F.col("net") > 0, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(F.col("net") > 0, F.col("b")).otherwise(F.col("a")).alias("after")
    )


def latest_values(tied: DataFrame, precedence: DataFrame) -> DataFrame:
    """(_key, field, id, raw): the topologically latest of the values that compete for a field of a group.

    ``tied`` holds the competing rows (_key, field, value, raw, time, id).  A value
    is outdated if another one of the group is timed later, or if one of the two
    has no time and the other one succeeds it.  Among the values that are not
    outdated (all of them, if they lie on a circle) a later time wins, then the
    value that succeeds more of the others than succeed it, then the smaller id.
    """
    best = F.min(F.struct(F.coalesce(-F.col("time"), F.lit(2**62)).alias("t"), "id", "raw"))
    held = tied.groupBy("_key", "field", "value").agg(F.max("time").alias("last"), best.alias("best"))
    newest = held.groupBy("_key", "field").agg(F.max("last").alias("newest"))
    after = held.select("_key", "field", F.col("value").alias("after"), F.col("last").alias("after_last"))
    edges = (
        held.select("_key", "field", F.col("value").alias("before"), "last")
        .join(precedence, ["field", "before"])
        .join(after, ["_key", "field", "after"])
        .filter("last IS NULL OR after_last IS NULL")
        .select("_key", "field", F.explode(F.array(F.struct(F.col("before").alias("value"), F.lit(1).alias("out")), F.struct(F.col("after").alias("value"), F.lit(0).alias("out")))).alias("x"))
        .groupBy("_key", "field", "x.value")
        .agg(F.sum("x.out").alias("succeeded"), F.sum(1 - F.col("x.out")).alias("succeeds"))
    )
    outdated = (F.col("last") < F.col("newest")) | (F.coalesce("succeeded", F.lit(0)) > 0)
    rank = F.struct(
        F.coalesce(outdated, F.lit(False)).alias("outdated"), F.col("best.t").alias("t"),
        (F.coalesce("succeeded", F.lit(0)) - F.coalesce("succeeds", F.lit(0))).alias("net"), F.col("best.id").alias("id"), F.col("best.raw").alias("raw"),
    )
    joined = held.join(newest, ["_key", "field"]).join(edges, ["_key", "field", "value"], "left")
    return joined.groupBy("_key", "field").agg(F.min(rank).alias("r")).select("_key", "field", "r.id", "r.raw")


def survivors(incidents: DataFrame, fields: tuple[str, ...] = FIELDS, learn: bool = True) -> DataFrame:
    """(cluster_fingerprint, field_name, incident_id, value): whose value each field of the survivor takes.

    Groups share a fingerprint (trimmed, lower case; null and blank make no
    group) and have at least two incident ids.  Rank: trust tier (null and odd
    values are unknown), completeness (above 1 is a percentage; null last),
    currency (later ``last_discovered_at``; where a record of equal belief has
    none, see :func:`latest_values`, or with ``learn`` off after all timed ones),
    smaller id.  A field whose values are all unusable gives no row.  For
    ``evidence`` the record with most distinct non-blank urls wins, ties by rank
    with missing times last, and no row is given if there is none.  Redelivered
    rows change nothing; rows with a null id are ignored; other columns are
    ignored; an empty table gives an empty result.
    """
    urls = F.array_distinct(F.filter(F.transform("evidence", lambda e: F.trim(e["url"])), lambda u: u.isNotNull() & (u != "")))
    rows = _key(incidents).select("_key", "incident_id", "trust_tier", "extraction_completeness", "last_discovered_at", F.coalesce(F.size(urls), F.lit(0)).alias("_urls"), *fields)
    share = F.col("extraction_completeness")
    belief = F.struct((-_tier(F.col("trust_tier"))).alias("tier"), F.coalesce(-F.when(share > 1, share / 100).otherwise(share), F.lit(2.0)).alias("share"))
    ranked = rows.withColumn("_belief", belief).withColumn(
        "_rank", F.struct(F.col("_belief").alias("belief"), F.coalesce(-F.unix_micros("last_discovered_at"), F.lit(2**62)).alias("time"), F.col("incident_id").alias("id"))
    )
    best, untimed = [], []
    for f in fields:
        held = usable(F.col(f))
        best.append(F.min(F.when(held, F.struct(F.col("_rank").alias("r"), F.col(f).cast("string").alias("v")))).alias(f"_{f}"))
        untimed.append(F.min(F.when(held & F.col("last_discovered_at").isNull(), F.col("_belief"))).alias(f"_u_{f}"))
    evidence = F.min(F.when(F.col("_urls") > 0, F.struct((-F.col("_urls")).alias("n"), F.col("_rank").alias("r")))).alias("_evidence")
    grouped = (
        ranked.groupBy("_key")
        .agg(F.min("incident_id").alias("lo"), F.max("incident_id").alias("hi"), evidence, *best, *(untimed if learn else []))
        .filter(F.col("lo") != F.col("hi"))
    )
    # A field is open where a record without a time is among those of highest belief.
    open_ = {f: F.coalesce(F.col(f"_u_{f}") == F.col(f"_{f}.r.belief"), F.lit(False)) if learn else F.lit(False) for f in fields}
    chosen = F.array(
        *(F.struct(F.lit(f).alias("field"), F.col(f"_{f}.r.id").alias("id"), F.col(f"_{f}.v").alias("raw"), F.col(f"_{f}.r.belief").alias("belief"), open_[f].alias("open")) for f in fields),
        F.struct(F.lit("evidence").alias("field"), F.col("_evidence.r.id").alias("id"), F.lit(None).cast("string").alias("raw"), F.col("_evidence.r.belief").alias("belief"), F.lit(False).alias("open")),
    )
    picked = grouped.select("_key", F.explode(chosen).alias("x")).select("_key", "x.*").filter("id IS NOT NULL")
    result = picked.filter("NOT open").select("_key", "field", "id", "raw")
    if learn:
        values = field_values(_key(incidents), fields)
        undecided = picked.filter("open").select("_key", "field", "belief.tier", "belief.share")
        tied = values.join(undecided, ["_key", "field", "tier", "share"], "left_semi")
        result = result.unionByName(latest_values(tied, learn_precedence(values)))
    return result.select(F.col("_key").alias("cluster_fingerprint"), F.col("field").alias("field_name"), F.col("id").alias("incident_id"), F.col("raw").alias("value"))


def surviving_records(incidents: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One built record for each group: (cluster_fingerprint, the fields, evidence, sources).

    ``sources`` maps each field to the incident it comes from; a field that no
    record has is null, and so is evidence that none has.  Cases as in
    :func:`survivors`.
    """
    found = survivors(incidents, fields)
    pick = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    built = found.groupBy("cluster_fingerprint").agg(
        *(pick(f, "value").alias(f) for f in fields), pick("evidence", "incident_id").alias("_from"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "incident_id")))).alias("sources"),
    )
    evidence = _key(incidents).select(F.col("_key").alias("cluster_fingerprint"), F.col("incident_id").alias("_from"), "evidence").groupBy("cluster_fingerprint", "_from").agg(F.first("evidence", ignorenulls=True).alias("evidence"))
    return built.join(evidence, ["cluster_fingerprint", "_from"], "left").select("cluster_fingerprint", *fields, "evidence", "sources")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "incidents")).drop("value")


def p1_untimed(spark, sf_dir: str) -> DataFrame:
    """The same where a record that was seen once only counts as one without a time."""
    incidents = table(spark, sf_dir, "incidents")
    again = F.when(F.col("last_discovered_at") != F.col("first_discovered_at"), F.col("last_discovered_at"))
    return survivors(incidents.withColumn("last_discovered_at", again))


def p1_records(spark, sf_dir: str) -> DataFrame:
    """The built records, with their evidence as its urls in order."""
    built = surviving_records(table(spark, sf_dir, "incidents"))
    return built.select("cluster_fingerprint", *FIELDS, F.array_join(F.transform("evidence", lambda e: F.coalesce(e["url"], F.lit(""))), "\n").alias("evidence_urls"))


_FIELD_SQL = " UNION ALL ".join(
    f"SELECT f, '{c}' AS field_name, incident_id, row_number() OVER (PARTITION BY f ORDER BY tier, share DESC NULLS LAST, last_discovered_at DESC NULLS LAST, incident_id) AS rn, {c} AS value"
    f" FROM g WHERE {c} IS NOT NULL AND trim({c}) <> '' AND lower(trim({c})) NOT IN ({', '.join(repr(x) for x in NO_VALUE)})"
    for c in FIELDS
)
_RANKED = f"""
WITH i AS (SELECT DISTINCT lower(trim(cluster_fingerprint)) AS f, incident_id, product_name, company_name, hazard_type, country, consumer_guidance, last_discovered_at,
  CASE lower(trim(trust_tier)) WHEN 'official' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS tier,
  CASE WHEN extraction_completeness > 1 THEN extraction_completeness / 100 ELSE extraction_completeness END AS share,
  len(list_distinct(list_filter(list_transform(evidence, lambda e: trim(e.url)), lambda u: u IS NOT NULL AND u <> ''))) AS urls, evidence
  FROM incidents WHERE trim(cluster_fingerprint) <> ''),
g AS (SELECT i.* FROM i JOIN (SELECT f FROM i GROUP BY f HAVING count(DISTINCT incident_id) >= 2) USING (f)),
r AS ({_FIELD_SQL} UNION ALL SELECT f, 'evidence', incident_id, row_number() OVER (PARTITION BY f ORDER BY urls DESC, tier, share DESC NULLS LAST, last_discovered_at DESC NULLS LAST, incident_id),
  array_to_string(list_transform(evidence, lambda e: coalesce(e.url, '')), chr(10)) FROM g WHERE urls > 0)
"""
P1_SQL = _RANKED + "SELECT f AS cluster_fingerprint, field_name, incident_id FROM r WHERE rn = 1"
P1_RECORDS_SQL = (
    _RANKED + "SELECT f AS cluster_fingerprint, "
    + ", ".join(f"max(value) FILTER (field_name = '{c}') AS {c}" for c in FIELDS)
    + ", max(value) FILTER (field_name = 'evidence') AS evidence_urls FROM r WHERE rn = 1 GROUP BY f"
)
