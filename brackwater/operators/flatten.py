"""Deeply nested records turned into related flat tables in one pass.

A depth-first visitor walks each record once and emits tagged rows: table tag,
row key, parent key, the positions of parent and child, and the object itself
as JSON text.  The rows are written (or filtered) by tag and each tag's schema
is applied afterwards, so one scan serves all child tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.runtime import shared_path

#: tag -> (field, children); the tree of one record kind.
Tree = dict[str, tuple[str, dict]]

UK_TREE: Tree = {
    "problem": ("problem", {"allergen": ("allergen", {})}),
    "related_media": ("relatedMedia", {}),
    "product": ("productDetails", {"batch": ("batchDescription", {})}),
}
INCIDENT_TREE: Tree = {"evidence": ("evidence", {"alias": ("redirected_url_aliases", {})})}

EMITTED = "rec_id string, child string, row_key string, parent_key string, parent_pos int, pos int, payload string"

#: DDL applied to the payload of each tag.
SCHEMAS = {
    "problem": "`@id` string, riskStatement string",
    "allergen": "label string, notation string",
    "related_media": "`@id` string, title string",
    "product": "productName string, packSizeDescription string",
    "batch": "batchCode string, bestBeforeDescription string",
    "evidence": "url string, title string, publication_date string, source_kind string, content_hash string, "
    "domain string, publisher string",
    "alias": "value string",
}


def _refuse(constant: str):
    raise ValueError(constant)


def _parse(text: str):
    """Strict JSON: NaN and Infinity are no JSON."""
    return json.loads(text, parse_constant=_refuse)


def _opened(value):
    """What a field holds; JSON text of a list or object counts as its content."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            inner = _parse(value)
        except (ValueError, RecursionError):
            return value
        return _opened(inner) if isinstance(inner, str) else inner
    return value


def _usable(value, scalars: bool) -> bool:
    if isinstance(value, dict):
        return bool(value)
    return scalars and value is not None and not isinstance(value, list)


def visit(rec_id: str | None, record: dict, tree: Tree, parent: tuple[str, int]) -> Iterator[tuple]:
    """Depth-first rows of one record: (rec_id, child, row_key, parent_key, parent_pos, pos, payload)."""
    for tag, (field, children) in tree.items():
        held = _opened(record.get(field))
        if held is None:
            continue
        for pos, item in enumerate(held if isinstance(held, list) else [held]):
            item = _opened(item)
            if not _usable(item, tag == "alias"):
                continue
            key = f"{parent[0]}/{tag}/{pos}"
            own = {k: v for k, v in item.items() if k not in {f for f, _ in children.values()}} if isinstance(item, dict) else {"value": item}
            yield rec_id, tag, key, parent[0], parent[1], pos, json.dumps(own, ensure_ascii=False)
            if children and isinstance(item, dict):
                yield from visit(rec_id, item, children, (key, pos))


def emit_tagged(df: DataFrame, id_col: str, json_col: str, tree: Tree) -> DataFrame:
    """All child rows of the records whose JSON text is in ``json_col``.

    Text that is no valid JSON object gives nothing, as do nulls and empty
    objects, although they keep their place in a list.  A single object stands
    at position 0; a list or object delivered as JSON text counts as what it
    holds.  A record delivered again as an exact copy gives its rows again; use
    :func:`flat_keys` or ``distinct`` where a record must count once.
    """
    shape = pa.schema(
        [("rec_id", pa.string()), ("child", pa.string()), ("row_key", pa.string()), ("parent_key", pa.string()),
         ("parent_pos", pa.int32()), ("pos", pa.int32()), ("payload", pa.string())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in shape.names]
            for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = _parse(text) if text else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    for row in visit(rec_id, record, tree, (rec_id or "", -1)):
                        for column, value in zip(out, row):
                            column.append(value)
                if len(out[0]) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)
                    out = [[] for _ in shape.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)

    return df.select(F.col(id_col).alias("rec_id"), F.col(json_col).alias("record")).mapInArrow(walk, EMITTED)


def uk_rows(uk_recall: DataFrame) -> DataFrame:
    """Tagged rows of the UK items."""
    return emit_tagged(uk_recall, "notation", "payload", UK_TREE)


def incident_rows(incidents: DataFrame) -> DataFrame:
    """Tagged rows of the incidents' evidence and its aliases."""
    packed = incidents.select("incident_id", F.to_json(F.struct("evidence"), {"ignoreNullFields": "true"}).alias("record"))
    return emit_tagged(packed, "incident_id", "record", INCIDENT_TREE)


def flat_keys(tagged: DataFrame) -> DataFrame:
    """Each child row once: (rec_id, child, parent_pos, pos)."""
    return tagged.select("rec_id", "child", "parent_pos", "pos").distinct()


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write the rows partitioned by tag; a reader of one child table prunes the others."""
    tagged.dropDuplicates(["rec_id", "child", "row_key"]).write.partitionBy("child").mode("overwrite").parquet(path)


def _typed(rows: DataFrame, tag: str) -> DataFrame:
    """The rows of one tag with its schema applied; fields that the schema does not name stay in ``payload``."""
    return rows.select("rec_id", "row_key", "parent_key", "parent_pos", "pos", F.from_json("payload", SCHEMAS[tag]).alias("x"), "payload").select(
        "rec_id", "row_key", "parent_key", "parent_pos", "pos", "x.*", "payload"
    )


def child_tables(tagged: DataFrame, tags: tuple[str, ...]) -> dict[str, DataFrame]:
    """One typed table for each tag, from a single pass: the tagged rows are written once by tag and read back pruned."""
    spark = tagged.sparkSession
    path = shared_path(spark, "children")
    write_tables(tagged, path)
    shape = ", ".join(f for f in EMITTED.split(", ") if not f.startswith("child ")) + ", child string"
    rows = spark.read.schema(shape).parquet(path)
    return {tag: _typed(rows.filter(F.col("child") == tag), tag) for tag in tags}


def typed_table(tagged: DataFrame, tag: str) -> DataFrame:
    """One child table with its schema applied, each row with its parent's key, without the write."""
    return _typed(tagged.filter(F.col("child") == tag).dropDuplicates(["row_key"]), tag)
