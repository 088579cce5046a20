"""Session helpers: settings this library is tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; the cluster's own settings win elsewhere."""
    builder = SparkSession.builder.appName("plumbline")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    A session on one machine without that setting (a test) gets a folder of its own; on a cluster
    the machines would not see each other's files, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="plumbline-")


def shared_folder(spark: SparkSession) -> str:
    """A new path under the cluster's checkpoint folder, for tables that jobs hand to each other."""
    return f"{checkpoint_root(spark)}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the cluster's shared folder and read from there.

    Later steps then neither repeat the work nor depend on the executors that did it.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)
