"""The domain relations: each record of a table once, by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.operators.upsert import last_per_key
from brackwater.runtime import table


def alerts(spark: SparkSession, sf_dir: str, where: Column | str | None = None) -> DataFrame:
    """Each alert once.  Repeats are exact copies, so ``where`` is applied before they are removed and reaches the scan."""
    held = table(spark, sf_dir, "alerts").drop("received_at")
    return (held if where is None else held.filter(where)).dropDuplicates(["alert_id"])


def incidents(spark: SparkSession, sf_dir: str, where: Column | str | None = None) -> DataFrame:
    """Each incident once; ``where`` as in :func:`alerts`."""
    held = table(spark, sf_dir, "incidents")
    return (held if where is None else held.filter(where)).dropDuplicates(["incident_id"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each candidate."""
    return last_per_key(table(spark, sf_dir, "candidates"), ["candidate_id"], ["last_seen_at", "attempt_count"])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").dropDuplicates(["source_name"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows: a user is a run, an event type is a stage or status."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
