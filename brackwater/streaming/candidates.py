"""Streaming forms of the stateful operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.operators.upsert import last_per_key
from brackwater.runtime import remove_path


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hourly counts of a stream of events; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def refresh_sessions(events: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """Debounced change notices: one row for each burst of events of a user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def upsert_batches(path: str, keys: list[str], order: list[str], notify: Callable[[int], None] | None = None, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the last row of each key in Parquet under ``path``.

    The store is divided by a hash of the key.  A batch rewrites the parts that
    it touches, each into a folder named by part and epoch, and keeps the folder
    that it started from; older ones are deleted, other parts are not read.
    Replaying the last batch starts from the same folder and writes the same
    one again, so a restart changes nothing.  Read the store with
    :func:`read_store`.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = sorted(r[0] for r in placed.select("_part").distinct().collect())
        if not touched:
            return
        held = _folders(spark, path)
        base = {part: max((e for q, e in held.values() if q == part and e < epoch), default=-1) for part in touched}
        before = [f"{path}/p{part}-e{at}" for part, at in base.items() if at >= 0]
        merged = placed
        if before:
            merged = spark.read.schema(batch.schema).parquet(*before).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).unionByName(placed)
        latest = last_per_key(merged, ["_part", *keys], order)
        staged = f"{path}/_epoch{epoch}"
        latest.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(staged)
        for part in touched:
            _move(spark, f"{staged}/_part={part}", f"{path}/p{part}-e{epoch}")
        remove_path(spark, staged)
        for name, (part, at) in held.items():
            if part in base and at < base[part]:
                remove_path(spark, f"{path}/{name}")
        if notify is not None:
            changed = batch.select(*keys).distinct().count()
            if changed > 0:
                notify(changed)

    return write


def _folders(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Name, part and epoch of the folders of a store."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return {n: (int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"p(\d+)-e(\d+)", n))}


def _move(spark: SparkSession, source: str, target: str) -> None:
    remove_path(spark, target)
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a store: of each part the folder of the latest epoch."""
    held = _folders(spark, path)
    newest = [f"{path}/{n}" for n, (part, at) in held.items() if at == max(e for q, e in held.values() if q == part)]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)
