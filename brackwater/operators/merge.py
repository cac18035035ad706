"""Several records of one matter folded into one, field by field.

The fold is ordered (by ``_at``, then ``_id``), yet every rule of it is an
aggregate: the last usable value, the longest label, the first terminal status.
So the records of a group are never brought together; only array fields are
united from their distinct elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.functions import scoring

#: Statuses that a merge never changes.
TERMINAL = ("dismissed", "superseded", "officially_confirmed")
#: Text fields in which a later record fills or replaces an earlier one.
FILLED = ("product_category", "incident_reason", "summary", "consumer_guidance", "primary_source_domain", "primary_publisher", "original_language", "analyst_notes")
#: Labels of which the most specific one stays.
LABELS = ("product_name", "company_name", "hazard_type")
UNITED = ("affected_regions", "linked_official_alert_ids", "processing_errors")


def held(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit("")) != ""


def last_held(column: str) -> Column:
    """The value of the last record that has one."""
    return F.max_by(F.when(held(column), F.col(column)), F.when(held(column), F.struct("_at", "_id")))


def longest(column: str) -> Column:
    """The longest value, of equally long ones the first."""
    tidy = F.trim(column)
    return F.max_by(F.when(held(tidy), tidy), F.when(held(tidy), F.struct(F.length(tidy), -F.unix_micros("_at"))))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != ""))


def most_specific(column: str) -> Column:
    """The value with most words, then the longest, then the first."""
    tidy = F.trim(column)
    return F.max_by(F.when(held(tidy), tidy), F.when(held(tidy), F.struct(word_count(tidy), F.length(tidy), -F.unix_micros("_at"))))


def united(rows: DataFrame, column: str) -> DataFrame:
    """(key, column): the distinct non-null elements of an array field, in order of first appearance."""
    each = rows.select("key", "_at", "_id", F.posexplode(column).alias("pos", "x")).filter("x IS NOT NULL")
    firsts = each.groupBy("key", "x").agg(F.min(F.struct("_at", "_id", "pos")).alias("at"))
    return firsts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(column))


def merged_evidence(rows: DataFrame, url_key) -> DataFrame:
    """(key, url_key, title, content_hash, domain, publisher, publication_date, source_kind) of each page of a group.

    Text fields and the date come from the last item that has them, the kind
    from the last item; ``url_key`` makes two addresses of one page equal.
    """
    each = rows.select("key", "_at", "_id", F.posexplode("evidence").alias("pos", "e")).filter("e IS NOT NULL AND trim(e.url) <> ''")
    each = each.select("key", F.struct("_at", "_id", "pos").alias("at"), "e.*").withColumn("url_key", url_key(F.col("url")))
    last = lambda c: F.max_by(F.when(held(c), F.col(c)), F.when(held(c), F.col("at"))).alias(c)
    date = F.max_by("publication_date", F.when(F.col("publication_date").isNotNull(), F.col("at"))).alias("publication_date")
    return each.groupBy("key", "url_key").agg(*(last(c) for c in ("title", "content_hash", "domain", "publisher")), date, F.max_by("source_kind", "at").alias("source_kind"))


def merge_groups(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """One record for each key of ``rows`` (key, _at, _id and the incident's columns).

    ``evidence`` are the pages of :func:`merged_evidence`.  A first terminal
    status stays; else two independent sources corroborate, as does a first
    record that was corroborated; a single record keeps its status.
    """
    identity = F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.col("url_key"))
    sources = evidence.select("key", identity.alias("who"), scoring.base_weight(F.col("source_kind")).alias("w"), "source_kind").groupBy("key").agg(
        F.countDistinct("who").alias("independent"), F.max(F.when(F.col("source_kind").isNotNull(), F.struct("w", "source_kind"))).alias("kind"), F.count("*").alias("pages")
    )
    own = F.max(F.struct(scoring.base_weight(F.col("source_kind")).alias("w"), F.coalesce("source_kind", F.lit("unknown")).alias("source_kind"))).alias("own_kind")
    at = F.struct("_at", "_id")
    terminal = F.col("verification_status").isin(*TERMINAL)
    folded = rows.groupBy("key").agg(
        F.count("*").alias("records"), F.min_by("incident_id", at).alias("incident_id"),
        F.min_by("verification_status", at).alias("first_status"), F.min_by(F.when(terminal, F.col("verification_status")), F.when(terminal, at)).alias("terminal"),
        *(last_held(c).alias(c) for c in FILLED), *(most_specific(c).alias(c) for c in LABELS), longest("country").alias("country"),
        F.min("first_discovered_at").alias("first_discovered_at"), F.max("last_discovered_at").alias("last_discovered_at"),
        F.max("extraction_completeness").alias("extraction_completeness"), last_held("publication_date").alias("publication_date"), own,
    )
    status = (
        F.when(F.col("records") == 1, F.col("first_status")).when(F.col("terminal").isNotNull(), F.col("terminal"))
        .when((F.coalesce("independent", F.lit(1)) > 1) | (F.col("first_status") == "corroborated"), "corroborated").otherwise("pending")
    )
    kind = F.greatest("own_kind", F.coalesce("kind", "own_kind"))["source_kind"]
    return (
        folded.join(sources, "key", "left").withColumn("verification_status", status).withColumn("source_kind", kind)
        .withColumn("independent", F.greatest(F.lit(1), F.coalesce("independent", F.lit(1)))).withColumn("pages", F.coalesce("pages", F.lit(0)))
        .drop("first_status", "terminal", "own_kind", "kind")
    )
