"""Queries of the general data-preparation operators (problems 3 and 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.operators import flatten, instants
from brackwater.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    uk = flatten.flat_keys(flatten.uk_rows(table(spark, sf_dir, "uk_recall")))
    incidents = flatten.flat_keys(flatten.incident_rows(table(spark, sf_dir, "incidents")))
    return uk.unionByName(incidents)


UK_TAGS, INCIDENT_TAGS = ("problem", "allergen", "related_media", "product", "batch"), ("evidence", "alias")


def p3_child_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven child tables: (child, rec_id, row_key, parent_key, parent_pos, pos, fields), the typed fields as a map.

    Each kind of record is walked once and written by tag; every table is read from its own part.
    """
    uk = flatten.child_tables(flatten.uk_rows(table(spark, sf_dir, "uk_recall")), UK_TAGS)
    own = flatten.child_tables(flatten.incident_rows(table(spark, sf_dir, "incidents")), INCIDENT_TAGS)
    keys = ("rec_id", "row_key", "parent_key", "parent_pos", "pos")
    parts = []
    for tag, child in (uk | own).items():
        named = [c for c in child.columns if c not in (*keys, "payload")]
        fields = F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.col(f"`{c}`")) for c in named))
        parts.append(child.select(F.lit(tag).alias("child"), *keys, fields.alias("fields")))
    return reduce(DataFrame.unionByName, parts)


def p3_evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flatten.child_tables(flatten.incident_rows(table(spark, sf_dir, "incidents")), INCIDENT_TAGS)["evidence"]
    return found.select("rec_id", "pos", "url", "title", "publication_date", "source_kind", "content_hash", "domain", "publisher")


P3_EVIDENCE_SQL = """WITH i AS (SELECT DISTINCT ON (incident_id) incident_id, evidence FROM incidents), e AS (SELECT incident_id, unnest(evidence) AS e, unnest(range(len(evidence))) AS pos FROM i)
SELECT incident_id AS rec_id, pos::int AS pos, e.url AS url, e.title AS title, strftime(e.publication_date, '%Y-%m-%d') AS publication_date, e.source_kind AS source_kind, e.content_hash AS content_hash, e.domain AS domain, e.publisher AS publisher
FROM e WHERE e IS NOT NULL AND (e.url IS NOT NULL OR e.title IS NOT NULL OR e.publication_date IS NOT NULL OR e.source_kind IS NOT NULL OR e.content_hash IS NOT NULL OR e.domain IS NOT NULL OR e.publisher IS NOT NULL OR e.redirected_url_aliases IS NOT NULL)"""

_PIECE = """{name} AS (SELECT rec_id, {parent} AS parent_pos, x, pos FROM (SELECT rec_id, {parent}, unnest(l) AS x, unnest(range(len(l)))::int AS pos FROM
  (SELECT rec_id, {parent}, CASE WHEN json_type(v) = 'ARRAY' THEN v::json[] WHEN v IS NOT NULL AND json_type(v) <> 'NULL' THEN [v] END AS l FROM
  (SELECT rec_id, {parent}, CASE WHEN json_type(v0) = 'VARCHAR' AND json_valid(v0->>'$') THEN (v0->>'$')::json ELSE v0 END AS v FROM (SELECT rec_id, {parent}, {value} AS v0 FROM {source})))))"""


def _piece(name: str, source: str, value: str, parent: str) -> str:
    return _PIECE.format(name=name, source=source, value=value, parent=parent)


_OPEN = "(CASE WHEN json_type(x) = 'VARCHAR' AND json_valid(x->>'$') THEN (x->>'$')::json ELSE x END)"
_OBJECT = f"json_type({_OPEN}) = 'OBJECT' AND len(json_keys({_OPEN})) > 0"
P3_SQL = f"""WITH u AS (SELECT DISTINCT notation AS rec_id, -1 AS top, payload::json AS p FROM uk_recall WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
{_piece('problem', 'u', "p->'problem'", 'top')}, {_piece('media', 'u', "p->'relatedMedia'", 'top')}, {_piece('product', 'u', "p->'productDetails'", 'top')},
pr AS (SELECT rec_id, pos AS up, {_OPEN} AS o FROM problem WHERE {_OBJECT}), pd AS (SELECT rec_id, pos AS up, {_OPEN} AS o FROM product WHERE {_OBJECT}),
{_piece('allergen', 'pr', "o->'allergen'", 'up')}, {_piece('batch', 'pd', "o->'batchDescription'", 'up')},
i AS (SELECT DISTINCT ON (incident_id) incident_id AS rec_id, evidence FROM incidents),
e AS (SELECT rec_id, unnest(evidence) AS e, unnest(range(len(evidence)))::int AS pos FROM i),
a AS (SELECT rec_id, pos AS up, unnest(e.redirected_url_aliases) AS x, unnest(range(len(e.redirected_url_aliases)))::int AS pos FROM e WHERE e IS NOT NULL)
SELECT rec_id, 'problem' AS child, parent_pos, pos FROM problem WHERE {_OBJECT} UNION SELECT rec_id, 'related_media', parent_pos, pos FROM media WHERE {_OBJECT}
UNION SELECT rec_id, 'product', parent_pos, pos FROM product WHERE {_OBJECT} UNION SELECT rec_id, 'allergen', parent_pos, pos FROM allergen WHERE {_OBJECT}
UNION SELECT rec_id, 'batch', parent_pos, pos FROM batch WHERE {_OBJECT}
UNION SELECT rec_id, 'evidence', -1, pos FROM e WHERE e IS NOT NULL UNION SELECT rec_id, 'alias', up, pos FROM a WHERE x IS NOT NULL"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        instants.normalise_instants(table(spark, sf_dir, name), key, column, zone, month_first).select(
            F.lit(name).alias("tbl"), "rec_id", "utc_text"
        )
        for name, key, column, zone, month_first in instants.FEEDS
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p3_found": p3_found, "p3_child_tables": p3_child_tables, "p3_evidence_table": p3_evidence_table, "p6_found": p6_found}
ORACLES = {"p3_found": P3_SQL, "p3_evidence_table": P3_EVIDENCE_SQL}
