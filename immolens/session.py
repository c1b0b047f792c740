"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter at scale: AQE re-plans joins (runtime broadcast of
# small sides, skew splitting) and right-sizes shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of DataFrames that are gone are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for large inputs (hundreds of TB): let AQE size shuffle partitions
# from a high initial count towards ~256 MB each, read ~256 MB file splits,
# and split skewed join partitions.  Broadcasts stay behind AQE's measured
# size check.
SCALE_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.shuffle.partitions": "20000",
}


def get_session(app: str = "immolens", master: str | None = None,
                shuffle_partitions: int | None = None,
                conf: dict | None = None, large: bool = False) -> SparkSession:
    """Session with the defaults above; ``large=True`` adds ``SCALE_CONF``."""
    builder = SparkSession.builder.appName(app)
    if large:
        conf = {**SCALE_CONF, **(conf or {})}
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that stored tables go to: ``spark.checkpoint.dir``.

    A cluster must name one that all its executors share; only a session
    with a local master falls back to a temporary folder.
    """
    folder = checkpoint_dir(spark)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark, tempfile.mkdtemp(prefix="immolens-"))


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The session setting wins.  ``fallback`` is applied only when nothing is
    configured (local tests); on a cluster it must be a shared filesystem.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if fallback:
        os.makedirs(fallback, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        return fallback
    return None
