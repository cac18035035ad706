"""Exact nearest neighbours by cosine for a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.runtime import shared_path

#: Query vectors on the driver and in the tasks at once.
BLOCK = 4096
_SHAPE = "query_id bigint, vec_id bigint, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    m = np.asarray(column.to_pylist(), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties by smaller id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.take_along_axis(np.broadcast_to(ids, scores.shape), order, axis=1), np.take_along_axis(scores, order, axis=1)


def _scan_block(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[DataFrame, object]:
    """At most k candidates of each query for each task; and the broadcast block."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        kept_ids, kept = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            scores = vectors @ _matrix(batch.column(1)).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            new_ids, new = _best(own, scores, k)
            all_ids, all_scores = np.concatenate([kept_ids, new_ids], axis=1), np.concatenate([kept, new], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            kept_ids, kept = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_scores, order, axis=1)
        good = kept.ravel() > -np.inf
        q = np.repeat(ids, kept.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q[good]), pa.array(kept_ids.ravel()[good]), pa.array(kept.ravel()[good])], names=["query_id", "vec_id", "score"])

    return rows.select("vec_id", "embedding").mapInArrow(scan, _SHAPE), shared


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, scores: bool = False) -> DataFrame:
    """(query_id, vec_id, rank): the ``k`` nearest other rows of each query vector, ties by smaller id; on demand with its ``score``.

    The stated queries come through the driver one block at a time.  Every task
    keeps the k best of each query of the block over all its rows; these bounded
    candidates are written to the shared folder and merged by rank.  Null
    vectors are ignored; an empty query set gives an empty result.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "nearest")
    stated = queries.select("vec_id", "embedding").filter("embedding IS NOT NULL").toLocalIterator()
    held_rows = rows.filter("embedding IS NOT NULL")
    part: list = []

    def flush() -> None:
        ids = np.array([r.vec_id for r in part], dtype=np.int64)
        found, shared = _scan_block(held_rows, ids, _matrix(pa.array([r.embedding for r in part])), k)
        found.write.mode("append").parquet(path)
        shared.destroy()
        part.clear()

    empty = True
    for row in stated:
        empty = False
        part.append(row)
        if len(part) == block:
            flush()
    if part:
        flush()
    if empty:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, rank int" + (", score double" if scores else ""))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(_SHAPE).parquet(path).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", *(["score"] if scores else []))


def merge_decisions(near: DataFrame, labels: DataFrame, review: float, auto: float) -> DataFrame:
    """(query_id, vec_id, decision) of each query with a neighbour of its own label at ``review`` or above.

    ``near`` are ranked neighbours with scores, ``labels`` has vec_id and label.
    The first such neighbour decides: merge from ``auto`` on, else review.
    """
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    met = near.filter(F.col("score") >= review).join(own, "query_id").join(labels.select("vec_id", "label"), "vec_id").filter(F.col("own") == F.col("label"))
    first = met.groupBy("query_id").agg(F.min(F.struct("rank", "vec_id", "score")).alias("m"))
    return first.select("query_id", "m.vec_id", F.when(F.col("m.score") >= auto, "merge").otherwise("review").alias("decision"))
