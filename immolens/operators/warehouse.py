"""Star schema (M19): four dimensions, one fact table, integrity audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.functions.text import pad_zipcode
from immolens.operators.keys import ORDINAL, first_seen_ids, hash_ids, hash_key, keep_first

FACT_COLUMNS = ["id_annonce", "price", "title", "surface", "price_m2", "url", "image_url",
                "id_date", "id_location", "id_type", "id_author"]


def prepare_raw(raw: DataFrame) -> DataFrame:
    """C8 + C9: zipcode as 5-character text, calendar parts of ``created_at``."""
    return (raw.withColumn("zipcode", pad_zipcode("zipcode"))
            .withColumn("year", F.year("created_at"))
            .withColumn("month", F.month("created_at"))
            .withColumn("day", F.dayofmonth("created_at")))


# The natural key of each surrogate key, as listing columns.
NATURAL = {"id_type": ["type"], "id_location": ["city", "zipcode", "region"],
           "id_date": ["created_at", "year", "month", "day"]}
KEY_KINDS = {"sequence": first_seen_ids, "hash": hash_ids}


def dim_type(listings: DataFrame, keys: str = "sequence") -> DataFrame:
    return (KEY_KINDS[keys](listings, NATURAL["id_type"], "id_type")
            .select("id_type", F.col("type").alias("type_name")))


def dim_location(listings: DataFrame, keys: str = "sequence") -> DataFrame:
    return (KEY_KINDS[keys](listings, NATURAL["id_location"], "id_location")
            .select("id_location", "city", "zipcode", "region"))


def dim_author(listings: DataFrame, keys: str = "sequence") -> DataFrame:
    """Natural key: the author text itself."""
    return listings.select(F.col("author").alias("id_author")).distinct()


def dim_date(listings: DataFrame, keys: str = "sequence") -> DataFrame:
    return (KEY_KINDS[keys](listings, NATURAL["id_date"], "id_date")
            .select("id_date", "created_at", "year", "month", "day"))


DIMENSIONS = {"dim_type": dim_type, "dim_location": dim_location, "dim_author": dim_author,
              "dim_date": dim_date}


def fact_by_hash(listings: DataFrame) -> DataFrame:
    """J1-J3 with hash keys: every foreign key is computed in place, so there is
    no join.  What the inner joins drop (no type, no date) is dropped."""
    ads = keep_first(listings, "id", ORDINAL, unique=True)
    keyed = ads.where(F.col("type").isNotNull() & F.col("created_at").isNotNull()).withColumns(
        {name: hash_key(*cols) for name, cols in NATURAL.items()})
    return keyed.withColumnsRenamed({"id": "id_annonce", "author": "id_author"}).select(*FACT_COLUMNS)


def fact_ads(listings: DataFrame, types: DataFrame, locations: DataFrame,
             dates: DataFrame) -> DataFrame:
    """Listing rows keyed by the dimensions (inner joins).

    Repeated ids keep their first listing (a primary key cannot repeat).
    Location keys may be null, so that join is null-safe.  No broadcast hint:
    the dimensions grow with the data and AQE broadcasts them at run time
    only when their measured size allows it.
    """
    ads = keep_first(listings, "id", ORDINAL, unique=True)
    loc = locations
    joined = (ads
              .join(types, ads.type == types.type_name, "inner")
              .join(loc, ads.city.eqNullSafe(loc.city) & ads.zipcode.eqNullSafe(loc.zipcode)
                    & ads.region.eqNullSafe(loc.region), "inner")
              .join(dates.select("id_date", "created_at"), "created_at", "inner"))
    return joined.select(
        ads.id.alias("id_annonce"), ads.price, ads.title, ads.surface, ads.price_m2,
        ads.url, ads.image_url, "id_date", "id_location", "id_type",
        ads.author.alias("id_author")).select(*FACT_COLUMNS)


def build_star(raw: DataFrame, keys: str = "sequence") -> dict[str, DataFrame]:
    """``{dim_type, dim_location, dim_author, dim_date, fact_ads}``, with keys in
    order of first appearance or by hash of the natural key."""
    listings = prepare_raw(raw)
    dims = {name: make(listings, keys) for name, make in DIMENSIONS.items()}
    fact = fact_by_hash(listings) if keys == "hash" else fact_ads(
        listings, dims["dim_type"], dims["dim_location"], dims["dim_date"])
    return {**dims, "fact_ads": fact}


def integrity_audit(star: dict[str, DataFrame]) -> DataFrame:
    """violations per declared constraint, one row per rule.

    Each table is grouped by its key once, which gives repeated keys and
    nulls together and leaves one row per key.  The fact's NOT NULL and
    foreign-key rules share a pass that is left-joined to those keys; a null
    key breaks NOT NULL, not the foreign key (as in SQL).
    """
    fact, typ = star["fact_ads"], star["dim_type"]
    dims = {"dim_location": ("id_location", ["city"], "not null dim_location.city"),
            "dim_type": ("id_type", ["type_name"], "not null dim_type.type_name"),
            "dim_author": ("id_author", [], None),
            "dim_date": ("id_date", ["created_at", "year", "month", "day"], "not null dim_date")}

    def keyed(df, key, required):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), sum_(
            [F.lit(0), *(F.count_if(F.col(c).isNull()) for c in required)]).alias("_nulls"))

    def rows(df, **rules):
        return df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in rules.items()])

    def told(one, names):
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.col(c).alias("violations"))
            for c, rule in names.items()])))

    repeated = F.sum(F.when(F.col("_n") > 1, F.col("_n")))
    parts, keys = [], {}
    for name, (key, required, rule) in dims.items():
        keys[key] = keyed(star[name], key, required)
        names = {"pk": f"pk {name}.{key}"} | ({"nn": rule} if rule else {})
        parts.append(told(rows(keys[key], pk=repeated, **({"nn": F.sum("_nulls")} if rule else {})),
                          names))
    parts.append(told(rows(keyed(typ, "type_name", []), pk=repeated),
                      {"pk": "unique dim_type.type_name"}))
    parts.append(told(rows(keyed(fact, "id_annonce", []), pk=repeated),
                      {"pk": "pk fact_ads.id_annonce"}))
    not_null = ["price", "title", *keys]
    checked = fact.select(*not_null)
    for key, known in keys.items():
        known = known.select(F.col(key).alias(f"_{key}"))
        checked = checked.join(known, checked[key] == known[f"_{key}"], "left")
    parts.append(told(
        rows(checked, nn=sum_(F.count_if(F.col(c).isNull()) for c in not_null),
             **{k: F.count_if(F.col(k).isNotNull() & F.col(f"_{k}").isNull()) for k in keys}),
        {"nn": "not null fact_ads", **{k: f"fk fact_ads.{k}" for k in keys}}))
    return reduce(DataFrame.unionByName, parts)


def sum_(cols):
    return reduce(lambda a, b: a + b, cols)
