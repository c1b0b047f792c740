"""The marts as views over the star (S12): one definition, ``operators/marts.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from immolens.operators.marts import VIEWS

STAR = ("dim_type", "dim_location", "dim_author", "dim_date", "fact_ads")


def create_mart_views(spark: SparkSession, star: dict[str, DataFrame] | None = None) -> list[str]:
    """Create (or replace) the mart views, of the given star or of the star tables
    that are registered as views."""
    star = star or {name: spark.table(name) for name in STAR}
    for name, mart in VIEWS.items():
        mart(star).createOrReplaceTempView(name)
    return list(VIEWS)
