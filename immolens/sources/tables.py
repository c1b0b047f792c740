"""Reading the driver's parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of ``{sf_dir}/{name}.parquet``.

    Callers select only the columns they need, so the scan's ReadSchema is
    pruned and filters are pushed into the parquet reader.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
