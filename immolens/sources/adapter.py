"""Driver tables -> raw listings.

The test data has no listings table, so one listing is derived per order:

=========================  ==============================================
listing column             derived from
=========================  ==============================================
id, price, created_at      o_orderkey, o_totalprice, o_orderdate
surface, pieces            sum(l_quantity), count(*) of the order's lines
type                       first digit of o_orderpriority (TYPE_BY_DIGIT)
city, region               n_name || '_' || c_mktsegment, r_name
zipcode, author            cast(c_custkey as string), c_name
title                      type word, rooms and surface written as text
=========================  ==============================================

Real scraped listings are incomplete, so some attributes are left out
*after* the title is written (the title keeps the truth), following the
order's own attributes, and typed by hand: AUTOMOBILE titles hold no-break
spaces and MACHINERY cities are padded with them (HOUSEHOLD cities of the first
nation are nothing else); AUTOMOBILE orders of priority 4 are lofts, a type
that nothing announces.  Partially shipped orders (status 'P') state no
surface, open orders (status 'O') no room count, and customers of the
HOUSEHOLD segment leave the type as 'Autre'.  BUILDING customers write the
rooms as 'T<n>'.  Listings of FURNITURE customers are posted twice (a later
ordinal, price + 1000), so keep-first deduplication has work.  Nothing is
filtered away: every order yields a listing.

Plan: lineitem is pre-aggregated per order (partial aggregation before the
shuffle) and joined to orders, hash-partitioned on the order key; customers
join on the customer key; nation x region (25 rows in every scale factor) is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from immolens.sources.tables import table

# Bump when the derivation changes, so stale snapshots are not reused.
ADAPTER_VERSION = "3"

# Listing type by the first digit of the order priority, and
# the order / customer attributes that shape the raw listings.
TYPE_BY_DIGIT = {
    "1": "Appartement",
    "2": "Maison",
    "3": "Terrain",
    "4": "Autre",
    "5": "Parking",
}
NO_SURFACE_STATUS = "P"
NO_ROOMS_STATUS = "O"
UNTYPED_SEGMENT = "HOUSEHOLD"
T_ROOMS_SEGMENT = "BUILDING"
REPOSTED_SEGMENT = "FURNITURE"
NO_BREAK_SEGMENT = "AUTOMOBILE"      # writes no-break spaces in titles
PADDED_SEGMENT = "MACHINERY"         # puts them around the city
LOFT = ("AUTOMOBILE", "4")           # a type outside the usual five
NO_BREAK = "\u00a0"
MAPPED_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]

RAW_COLUMNS = ["id", "title", "type", "price", "surface", "pieces", "price_m2",
               "city", "zipcode", "region", "author", "url", "image_url",
               "created_at", "ordinal"]


def _type_from_priority(priority: Column) -> Column:
    digit = F.substring(priority, 1, 1)
    out = F.lit(None).cast("string")
    for d, name in TYPE_BY_DIGIT.items():
        out = F.when(digit == d, F.lit(name)).otherwise(out)
    return out


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing rows (with replays), columns ``RAW_COLUMNS``."""
    # Hash-partitioned on the order key: the partitioning a sort-merge join
    # with the per-order line aggregate needs anyway, and it spreads the
    # listing derivation over all cores when the join is broadcast.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority",
        "o_orderstatus") \
        .repartition(parts, "o_orderkey")
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                       "c_mktsegment")
    geo = F.broadcast(_geography(spark, sf_dir))   # 25 rows at every scale

    base = (orders
            .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .join(customer, orders.o_custkey == customer.c_custkey, "left")
            .join(geo, F.col("c_nationkey") == geo.n_nationkey, "left"))

    oid = F.col("o_orderkey")
    status, segment = F.col("o_orderstatus"), F.col("c_mktsegment")
    loft = (segment == LOFT[0]) & (F.substring("o_orderpriority", 1, 1) == LOFT[1])
    type_word = F.when(loft, F.lit("Loft")).otherwise(
        _type_from_priority(F.col("o_orderpriority")))
    blank = F.when(segment == NO_BREAK_SEGMENT, F.lit(NO_BREAK)).otherwise(F.lit(" "))
    name = F.concat(F.col("n_name"), F.lit("_"), segment)
    city = (F.when(segment == PADDED_SEGMENT, F.concat(F.lit(NO_BREAK), name, F.lit(NO_BREAK)))
            .when((segment == UNTYPED_SEGMENT) & (F.col("c_nationkey") == 0), F.lit(NO_BREAK))
            .otherwise(name))
    pieces_txt = F.col("n_lines").cast("string")
    surface_txt = F.col("qty").cast("bigint").cast("string")
    rooms_txt = F.when(segment == T_ROOMS_SEGMENT, F.concat(F.lit("T"), pieces_txt)) \
                 .otherwise(F.concat(pieces_txt, blank, F.lit("pièces")))
    tail = F.when(F.col("n_lines").isNotNull(),
                  F.concat(rooms_txt, F.lit(" "), surface_txt, blank, F.lit("m²")))

    surface = F.when(status == NO_SURFACE_STATUS, F.lit(None)).otherwise(F.col("qty")).cast("double")
    # One pass: re-posted listings are emitted twice (copy 1 = the repost).
    copy = F.explode(F.when(segment == REPOSTED_SEGMENT, F.array(F.lit(0), F.lit(1)))
                     .otherwise(F.array(F.lit(0)))).alias("copy")
    price = F.col("o_totalprice") + F.col("copy") * F.lit(1000.0)
    return base.select("*", copy).select(
        oid.alias("id"),
        F.concat_ws(" ", type_word, tail).alias("title"),
        F.when(segment == UNTYPED_SEGMENT, F.lit("Autre")).otherwise(type_word).alias("type"),
        price.alias("price"),
        surface.alias("surface"),
        F.when(status == NO_ROOMS_STATUS, F.lit(None)).otherwise(F.col("n_lines"))
         .cast("double").alias("pieces"),
        F.try_divide(price, surface).alias("price_m2"),
        city.alias("city"),
        F.col("c_custkey").cast("string").alias("zipcode"),
        F.col("r_name").alias("region"),
        F.col("c_name").alias("author"),
        F.concat(F.lit("ad/"), oid.cast("string")).alias("url"),
        F.concat(F.lit("img/"), oid.cast("string"), F.lit(".jpg")).alias("image_url"),
        F.col("o_orderdate").alias("created_at"),
        (oid * 2 + F.col("copy")).alias("ordinal"),
    )


def city_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates for the synthetic city names, derived from ``nation``.

    Only the cities of three segments get a position, so the city map drops
    the others, as it drops unknown towns.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.posexplode(F.array(*[F.lit(s) for s in MAPPED_SEGMENTS])).alias("k", "segment")
    return (nation.select("n_nationkey", "n_name", k)
            .select(F.concat(F.col("n_name"), F.lit("_"), F.col("segment")).alias("city"),
                    (F.lit(42.0) + F.col("n_nationkey") * 0.35 + F.col("k") * 0.1).alias("lat"),
                    (F.lit(-4.0) + F.col("n_nationkey") * 0.45 + F.col("k") * 0.2).alias("lng")))


def listings_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived listings as a stored snapshot (see ``snapshots.stored``).

    Raw listings are a stored file in the original application; deriving
    them lazily inside every query would make Catalyst inline the title and
    type expressions into each predicate that reads them.
    """
    from immolens.sources.snapshots import stored
    return stored(spark, "listings", f"{sf_dir}|{ADAPTER_VERSION}",
                  lambda: listings(spark, sf_dir))
