"""Records delivered as JSON: leaves with their paths, shapes, and fields chosen by what a path says.

Parsing and walking a record needs one Arrow pass; everything after it works on
rows (record, path, value) with built-in expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.operators.flatten import _parse

#: Words in a path and their points for an address, a date and a product name.
URL_POINTS = ((("source_url",), 120), (("url",), 100), (("link", "lien"), 60), (("source",), 30))
DATE_POINTS = ((("selected_recall_date",), 160), (("recall", "rappel"), 100), (("publication", "created"), 80), (("date",), 40), (("end", "fin", "closed"), -60))
NAME_POINTS = (
    (("headings",), 180), (("heading",), 120), (("productname", "product_name"), 110), (("product", "produit"), 80), (("model", "reference"), 40),
    (("brand", "marque", "establishment"), 20), (("visible_text",), -120), (("summary", "description", "advice"), -90),
)
#: Fields that a structured record must have, and defaults of a record made without a model.
REQUIRED = (
    "product_name", "product_category", "recall_reason", "summary", "recall_date", "risk_level", "hazard_type", "consumer_action", "source_url",
    "batch_id", "country_source", "affected_regions",
)
DEFAULTS = {
    "product_category": "Other", "recall_reason": "Recall reason unavailable", "risk_level": "Unknown", "hazard_type": "Unknown",
    "consumer_action": "Follow the source recall notice.", "country_source": "Unknown",
}
#: Fixed value: characters of a name beyond which each costs a point.
LONG_NAME = 180

LEAVES = "rec_id string, place int, path string, value string"


def leaves_of(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of every non-blank text leaf, in order."""
    if isinstance(value, str):
        if value.strip():
            yield path, value
    elif isinstance(value, dict):
        for key, child in value.items():
            yield from leaves_of(child, f"{path}.{key}" if path else str(key))
    elif isinstance(value, list):
        for i, child in enumerate(value):
            yield from leaves_of(child, f"{path}[{i}]")


def shape_of(value) -> str:
    """Keys and kinds of a value without its content, as text; equal for values of one structure."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{shape_of(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(shape_of, value)) + "]"
    return "v"


def tolerant_object(text: str | None) -> dict | None:
    """The first JSON object in a text that may have words before and after it; None if there is none."""
    text = text or ""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
            continue
        return found if isinstance(found, dict) else None
    return None


def _walked(df: DataFrame, id_col: str, json_col: str, shape: str, rows_of) -> DataFrame:
    fields = [f.rsplit(" ", 1) for f in shape.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(rec_id, *row) for row in rows_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return df.select(F.col(id_col).alias("rec_id"), F.col(json_col).alias("record")).mapInArrow(walk, shape)


def _parsed(text: str | None):
    try:
        return _parse(text) if text else None
    except (ValueError, RecursionError):
        return None


def text_leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(rec_id, place, path, value) of every non-blank text leaf; broken JSON gives nothing, repeats count once."""
    return _walked(df, id_col, json_col, LEAVES, lambda text: [(n, p, v) for n, (p, v) in enumerate(leaves_of(_parsed(text)))]).distinct()


def shapes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(rec_id, shape) of every record that is valid JSON."""
    return _walked(df, id_col, json_col, "rec_id string, shape string", lambda text: [] if (v := _parsed(text)) is None else [(shape_of(v),)]).distinct()


def tolerant_objects(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec_id, document): the first object of each text, written with sorted keys; texts without one give nothing."""
    def rows(text):
        found = tolerant_object(text)
        return [] if found is None else [(json.dumps(found, ensure_ascii=False, separators=(",", ":"), sort_keys=True),)]

    return _walked(df, id_col, text_col, "rec_id string, document string", rows).distinct()


def path_points(path: Column, points) -> Column:
    """Points of a path for the words in it."""
    low = F.lower(path)
    holds = lambda words: reduce(or_, (F.contains(low, F.lit(w)) for w in words))
    return sum((F.when(holds(words), n).otherwise(0) for words, n in points), F.lit(0))


def best_leaf(leaves: DataFrame, score: Column) -> DataFrame:
    """(rec_id, path, value, score): the leaf with most points, the first of equals."""
    ranked = leaves.withColumn("score", score)
    best = ranked.groupBy("rec_id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "path", "value")).alias("b"))
    return best.select("rec_id", "b.path", "b.value", "b.score")


def is_address(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike("^https?://")


def best_address(leaves: DataFrame) -> DataFrame:
    return best_leaf(leaves.filter(is_address(F.col("value"))), path_points(F.col("path"), URL_POINTS))


def best_name(leaves: DataFrame) -> DataFrame:
    long = F.greatest(F.length("value") - LONG_NAME, F.lit(0))
    return best_leaf(leaves.filter(~is_address(F.col("value"))), path_points(F.col("path"), NAME_POINTS) - long)


def missing_fields(stated: Column) -> Column:
    """Required fields that are not among the stated ones, in order."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), stated))


def _items(value) -> list:
    """The list in one of the three envelopes of feeds."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("results", "items") if isinstance(value.get(k), list)), None)
    return value if isinstance(value, list) else []


def envelope_items(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(rec_id, place, item): the items of a bare list or of ``results`` or ``items``; anything else gives nothing."""
    def rows(text):
        return [(i, json.dumps(x, ensure_ascii=False, sort_keys=True)) for i, x in enumerate(_items(_parsed(text)))]

    return _walked(df, id_col, json_col, "rec_id string, place int, item string", rows)


def bounded_items(df: DataFrame, id_col: str, json_col: str, field: str, most: int) -> DataFrame:
    """(rec_id, place, item): the first ``most`` objects of a list field; entries that are no objects are passed over."""
    def rows(text):
        record = _parsed(text)
        held = record.get(field) if isinstance(record, dict) else None
        objects = [x for x in held if isinstance(x, dict)] if isinstance(held, list) else []
        return [(i, json.dumps(x, ensure_ascii=False, sort_keys=True)) for i, x in enumerate(objects[:most])]

    return _walked(df, id_col, json_col, "rec_id string, place int, item string", rows).distinct()


def search_results(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(rec_id, rank, title, url, description) of a web-search reply; results without title or address are passed over."""
    def rows(text):
        reply = _parsed(text)
        web = reply.get("web") if isinstance(reply, dict) else None
        results = web.get("results") if isinstance(web, dict) else None
        out = []
        for rank, x in enumerate(results if isinstance(results, list) else [], 1):
            title, url, told = (str(x.get(k) or "").strip() for k in ("title", "url", "description")) if isinstance(x, dict) else ("", "", "")
            if title and url:
                out.append((rank, title, url, told))
        return out

    return _walked(df, id_col, json_col, "rec_id string, rank int, title string, url string, description string", rows)
