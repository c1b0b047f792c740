"""Summary marts over the star schema (A3-A5, J4, L1), in mergeable parts.

The fact is summed by the keys of the dimensions it is joined to (partial
sums before the shuffle), and only those sums are joined and summed again.
The sums are kept in parts that can be merged in any order (``numeric.sum_parts``),
so parts stored for each load of the warehouse give the same marts as all facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.functions.numeric import merged_parts, parts_mean, parts_round_mean, sum_parts

MEASURES = ("price", "surface", "price_m2")
KEYS = ("id_location", "id_type", "id_date")


def fact_parts(fact: DataFrame, *keys: str) -> DataFrame:
    """What the marts need of some facts: one row per combination of the keys."""
    return fact.groupBy(*(keys or KEYS)).agg(
        F.count("id_annonce").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"),
        *[x for m in MEASURES for x in sum_parts(m, m)])


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts of several loads, or of finer keys, added up."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[x for m in MEASURES for x in merged_parts(m)])


def _of(star: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Parts by some keys: of the stored parts if the star has them, else of the fact."""
    if "mart_parts" in star:
        return merged(star["mart_parts"], *keys)
    return fact_parts(star["fact_ads"], *keys)


def _joined(star: dict[str, DataFrame], joins: dict[str, str], *keys: str) -> DataFrame:
    parts = _of(star, *joins)
    return merged(reduce(lambda df, j: df.join(star[j[1]], j[0]), joins.items(), parts), *keys)


def _figures() -> list:
    """Volume, mean price, mean price per m² and mean surface of merged parts."""
    return [F.col("n").alias("volume_annonces"), parts_round_mean("price", 2).alias("prix_moyen"),
            F.round(parts_mean("price_m2"), 2).alias("prix_m2_moyen"),
            parts_round_mean("surface", 1).alias("surface_moyenne")]


def city_mart(star: dict[str, DataFrame]) -> DataFrame:
    """A3: volume, average price/surface/price per m², min and max per city."""
    return (_joined(star, {"id_location": "dim_location"}, "region", "city")
            .select("region", "city", *_figures(),
                    F.col("low").alias("prix_minimum"), F.col("high").alias("prix_maximum"))
            .orderBy(F.desc("volume_annonces"), "region", "city"))


def region_type_mart(star: dict[str, DataFrame]) -> DataFrame:
    """A4: the same measures per region and property type."""
    return (_joined(star, {"id_location": "dim_location", "id_type": "dim_type"},
                    "region", "type_name")
            .select("region", "type_name", *_figures())
            .orderBy("region", F.desc("volume_annonces"), "type_name"))


def monthly_mart(star: dict[str, DataFrame]) -> DataFrame:
    """A5: volume and averages per calendar month."""
    return (_joined(star, {"id_date": "dim_date"}, "year", "month")
            .select("year", "month", *_figures()[:3])
            .orderBy("year", "month"))


#: View name -> the mart that it shows
VIEWS = {"dm_stats_par_ville": city_mart, "dm_stats_region_type": region_type_mart,
         "dm_stats_mensuelles": monthly_mart}
