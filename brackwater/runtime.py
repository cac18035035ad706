"""Session helpers shared by all operators: table access, durable cuts, written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input table; a single Parquet file or a directory of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder for durable cuts.

    The folder named by ``spark.checkpoint.dir`` is taken when the session has
    one.  A temporary folder is set only where nothing is configured and all
    tasks run in this process (tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="brackwater-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Compute ``df`` once as a written table in the shared folder; see :func:`release`."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._stored_at = path
    return held


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*held: DataFrame | None) -> None:
    """Delete the tables that :func:`stored` wrote; nothing may read them any more."""
    for df in held:
        path = getattr(df, "_stored_at", None)
        if path:
            remove_path(df.sparkSession, path)
