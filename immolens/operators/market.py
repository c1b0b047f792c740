"""Market panels (B1-B6): dashboard, analysis, options, city map, alerts, report.

Two inputs, as in the reference application:

* ``market`` – the ML-ready listings (one-hot type flags, ``prix``,
  ``surface``, ``pieces``) with ``region`` and ``city`` joined back by id (J5);
* ``raw``    – the raw listings (``price``, ``surface``, ``city``, ``type``...).

Panel parameters are plain Python values turned into predicates on the
driver.  Each panel part is one DataFrame; per-type and per-city figures
come from a single grouped or conditional aggregate, never from a loop of
filtered scans.  Top-k lists carry a name tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from immolens.functions.numeric import exact_avg, spaced_thousands, trunc_long
from immolens.operators.keys import ORDINAL
from immolens.operators.stats import quantile_table, quantiles, scalars

# Panel vocabularies, sentinels, thresholds.
ALL_TYPES = "Tous"
ALL_REGIONS = "France entière"
ALL_CITIES = "Toutes villes"
ALL_ROOMS = "Toutes pièces"
PROPERTY_TYPES = ["Tous", "Appartement", "Maison", "Terrain", "Autre", "Parking"]
TYPE_COL_MAP = {
    "Appartement": "type_bien_APPARTEMENT",
    "Maison": "type_bien_MAISON",
    "Terrain": "type_bien_TERRAIN",
    "Autre": "type_bien_AUTRE",
    "Parking": "type_bien_PARKING",
}
ROOM_BUCKETS = {
    "1-2 pièces": (None, 2),
    "3-4 pièces": (3, 4),
    "5-6 pièces": (5, 6),
    "7+ pièces": (7, None),
}
ROOM_OPTIONS = ["Toutes pièces", "1-2 pièces", "3-4 pièces", "5-6 pièces", "7+ pièces"]
MARKET_TYPES = ["Appartement", "Maison", "Terrain"]
CARD_TYPES = ["Appartement", "Maison"]
STAT_TYPES = ["Appartement", "Maison", "Terrain", "Autre", "Parking"]
HISTOGRAM_MIN_STEP = 50000
TOP_CITIES = 10
TOP_CITY_MIN_COUNT = 3
MAP_CITIES = 30
ACTIVE_COUNT = 15
DEFAULT_TERCILES = (3000, 5000)
ALERT_CITIES = 5
ALERT_MIN_COUNT = 5
FREQUENT_CITIES = 30
SURFACE_RANGE_DEFAULT = (5, 500)
PIECES_RANGE_DEFAULT = (1, 15)
# Coordinates of the towns the map knows.
CITY_COORDINATES = [
    ("Paris", 48.8566, 2.3522), ("Marseille", 43.2965, 5.3698),
    ("Lyon", 45.7640, 4.8357), ("Toulouse", 43.6047, 1.4442),
    ("Nice", 43.7102, 7.2620), ("Nantes", 47.2184, -1.5536),
    ("Strasbourg", 48.5734, 7.7521), ("Montpellier", 43.6108, 3.8767),
    ("Bordeaux", 44.8378, -0.5792), ("Lille", 50.6292, 3.0573),
    ("Rennes", 48.1173, -1.6778), ("Reims", 49.2583, 3.0583),
    ("Toulon", 43.1242, 5.9280), ("Saint-Malo", 48.6493, -2.0007),
    ("Rouen", 49.4432, 1.0999), ("Limoges", 45.8336, 1.2611),
    ("Fréjus", 43.4332, 6.7370), ("Brest", 48.3904, -4.4861),
    ("Orléans", 47.9029, 1.9039), ("Poitiers", 46.5802, 0.3404),
    ("Agde", 43.3108, 3.4758), ("Perpignan", 42.6987, 2.8956),
    ("La Rochelle", 46.1603, -1.1511), ("Angers", 47.4784, -0.5632),
    ("Tours", 47.3941, 0.6848), ("Dijon", 47.3220, 5.0415),
    ("Grenoble", 45.1885, 5.7245), ("Le Mans", 48.0061, 0.1996),
    ("Aix-en-Provence", 43.5297, 5.4474), ("Clermont-Ferrand", 45.7772, 3.0870),
    ("Les Sables-d'Olonne", 46.4966, -1.7834), ("Le Havre", 49.4944, 0.1079),
    ("La Seyne-sur-Mer", 43.1009, 5.8854), ("Dunkerque", 51.0343, 2.3768),
    ("Hyères", 43.1204, 6.1286), ("Amiens", 49.8941, 2.2958),
    ("Saint-Raphaël", 43.4253, 6.7688),
]


def coordinates(spark) -> DataFrame:
    """The literal town table ``(city, lat, lng)``."""
    return spark.createDataFrame(CITY_COORDINATES, "city string, lat double, lng double")


# ------------------------------------------------------------------ J5
def enrich_by_id(features: DataFrame, raw: DataFrame, key: str = "id_annonce") -> DataFrame:
    """Attach raw ``region`` and ``city`` to ML-ready rows by listing id.

    Raw ids are made unique first, as a lookup needs: one aggregate takes each
    id's first row (a null ordinal comes last), combined map-side.
    """
    first = F.min_by(F.struct("region", "city"), F.struct(
        F.col(ORDINAL).isNull(), F.col(ORDINAL), F.col("region"), F.col("city")))
    lookup = raw.groupBy("id").agg(first.alias("_first")).select("id", "_first.region", "_first.city")
    base = features.drop(*[c for c in ("region", "city") if c in features.columns])
    return base.join(lookup, base[key] == lookup.id, "left").drop(lookup.id)


# ------------------------------------------------------------------ filters
def _parse_number(text):
    if text is None or not str(text).strip():
        return None
    try:
        return float(text)
    except ValueError:
        return None


def is_number(text) -> bool:
    return _parse_number(text) is not None


def panel_filter(df: DataFrame, type_str: str | None = None, region: str | None = None,
                 zone: str | None = None, smin=None, smax=None, rooms: str | None = None
                 ) -> DataFrame:
    """One predicate from a panel's parameters, for every panel.

    A parameter that is empty, a sentinel ('Tous', 'France entière', ...),
    not a number where one is needed, or about a column that is not there
    asks for nothing.  Types go through their flags, cities are
    case-sensitive, surface bounds are inclusive, and fractional room counts
    fall between the room buckets.
    """
    low, high = ROOM_BUCKETS.get(rooms, (None, None))
    asked = [
        (TYPE_COL_MAP.get(type_str), lambda c: c, type_str not in (None, "", ALL_TYPES)),
        ("region", lambda c: c == region, region not in (None, "", ALL_REGIONS)),
        ("city", lambda c: c == zone, zone not in (None, "", ALL_CITIES)),
        ("surface", lambda c: c >= _parse_number(smin), _parse_number(smin) is not None),
        ("surface", lambda c: c <= _parse_number(smax), _parse_number(smax) is not None),
        ("pieces", lambda c: c >= low, low is not None),
        ("pieces", lambda c: c <= high, high is not None),
    ]
    wanted = [test(F.col(name)) for name, test, given in asked if given and name in df.columns]
    return df.where(reduce(lambda x, y: x & y, wanted)) if wanted else df


def filter_by_type(df: DataFrame, type_str: str | None) -> DataFrame:
    """F4."""
    return panel_filter(df, type_str)


def filter_by_region(df: DataFrame, region: str | None) -> DataFrame:
    """F5."""
    return panel_filter(df, region=region)


def filter_analysis(df: DataFrame, zone=ALL_CITIES, type_str=ALL_TYPES, smin=None, smax=None,
                    rooms=ALL_ROOMS) -> DataFrame:
    """F4, F6-F8."""
    return panel_filter(df, type_str, zone=zone, smin=smin, smax=smax, rooms=rooms)


def room_bucket(col: str = "pieces") -> Column:
    """F8 as a column: bucket label, null for values between buckets."""
    p = F.col(col)
    out = F.lit(None).cast("string")
    for label, (lo, hi) in reversed(list(ROOM_BUCKETS.items())):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (p >= lo)
        if hi is not None:
            cond = cond & (p <= hi)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


# ------------------------------------------------------------------ B1
def _price_m2() -> Column:
    return F.try_divide(F.col("prix"), F.col("surface"))


def _whole(v) -> Column:
    """A truncated figure as a long literal."""
    return F.lit(int(v) if v is not None else None).cast("long")


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Median and mean price, median price per m² (null when no row has
    a positive surface), listing count; integers truncated.  Both medians
    come from one job, the rest from one aggregate."""
    (med,), (med_m2,) = quantile_table(df, [(F.col("prix"), None), (_price_m2(), None)], [0.5])
    return df.agg(
        _whole(med).alias("median_price"),
        trunc_long(exact_avg("prix")).alias("mean_price"),
        F.when(F.count_if(F.col("surface") > 0) > 0, _whole(med_m2)).alias("prix_m2"),
        F.count(F.lit(1)).alias("ads_count"))


def _per_type(df: DataFrame, types: list[str], measures) -> DataFrame:
    """Unpivot the type flags present into ``(type, order, <row cols>)`` rows
    and aggregate per type: one pass, one small grouped aggregate."""
    present = [(i, t) for i, t in enumerate(types) if TYPE_COL_MAP[t] in df.columns]
    if not present:
        return None
    tags = F.array(*[F.when(F.col(TYPE_COL_MAP[t]), F.struct(F.lit(t).alias("type"),
                                                              F.lit(i).alias("type_order")))
                     for i, t in present])
    long = df.select("*", F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("_t"))
    return long.groupBy("_t.type", "_t.type_order").agg(*measures)


def active_markets(df: DataFrame, r2: float | None = None) -> DataFrame:
    """Count, mean price and confidence per market type; empty types are
    omitted.  ``confidence = min(95, max(70, int(100*r2 + n/100)))``, null
    while no model has been trained (``r2`` is None)."""
    agg = _per_type(df, MARKET_TYPES, [F.count(F.lit(1)).alias("count"),
                                       trunc_long(exact_avg("prix")).alias("mean_price")])
    if agg is None:
        return df.sparkSession.createDataFrame(
            [], "type string, type_order int, count long, mean_price long, confidence long, "
                "label string")
    known = trunc_long(F.lit(float(r2 or 0) * 100) + F.col("count") / F.lit(100))
    confidence = (F.least(F.lit(95), F.greatest(F.lit(70), known)) if r2 is not None
                  else F.lit(None)).cast("long")
    return (agg.select("type", "type_order", "count", "mean_price",
                       confidence.alias("confidence"),
                       F.concat(F.col("count").cast("string"), F.lit(" annonces")).alias("label"))
            .orderBy("type_order").limit(3))


def _type_medians(df: DataFrame, types: list[str], *values: Column) -> list[dict]:
    """Truncated median of each value per type flag, all in the same job."""
    present = [t for t in types if TYPE_COL_MAP[t] in df.columns]
    got = quantile_table(df, [(v, F.col(TYPE_COL_MAP[t])) for v in values for t in present], [0.5])
    whole = [int(q) if q is not None else None for (q,) in got]
    return [dict(zip(present, whole[k * len(present):], strict=False)) for k in range(len(values))]


def _by_type(values: dict) -> Column:
    """A per-type literal, looked up by the ``type`` column."""
    out = F.lit(None).cast("long")
    for t, v in values.items():
        out = F.when(F.col("type") == F.lit(t), F.lit(v).cast("long")).otherwise(out)
    return out


def type_cards(df: DataFrame) -> DataFrame:
    """Count and median price for apartments and houses; a type without
    rows is kept with count 0 and a null median."""
    spark = df.sparkSession
    types = spark.createDataFrame([(t, i) for i, t in enumerate(CARD_TYPES)],
                                  "type string, type_order int")
    (medians,) = _type_medians(df, CARD_TYPES, F.col("prix"))
    agg = _per_type(df, CARD_TYPES, [F.count(F.lit(1)).alias("count")])
    agg = agg.withColumn("median_price", _by_type(medians)) if agg is not None else None
    out = F.broadcast(types).join(agg.drop("type_order"), "type", "left") if agg is not None \
        else types.withColumn("count", F.lit(0)).withColumn("median_price", F.lit(None))
    return (out.select("type", "type_order", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                       F.col("median_price").cast("long").alias("median_price"))
            .orderBy("type_order"))


def histogram_step(p_min: int, p_max: int) -> int:
    """An eighth of the price span, in whole minimal steps, at least one."""
    return HISTOGRAM_MIN_STEP * max(1, (p_max - p_min) // (8 * HISTOGRAM_MIN_STEP))


def histogram_of(df: DataFrame, col: str, count: Column, bounds: tuple,
                 legacy_edge: bool = False) -> DataFrame:
    """A9 over rows or counts of values: ``count`` aggregates a bin's rows."""
    low, high = bounds
    if low is None:
        return df.sparkSession.createDataFrame([], "bracket string, count long")
    p_min, p_max = int(low), int(high)
    step = histogram_step(p_min, p_max)
    out = df.where(F.col(col).isNotNull())
    if legacy_edge:
        n_bins = len(range(0, p_max + step, step)) - 1
        out = out.where(F.col(col) < F.lit(n_bins * step))
    lo = (F.floor(F.col(col) / F.lit(step)) * F.lit(step)).cast("long")
    return (out.groupBy(lo.alias("lo")).agg(count.alias("count"))
            .orderBy("lo")
            .select(F.concat((F.col("lo") / 1000).cast("long").cast("string"), F.lit("-"),
                             ((F.col("lo") + step) / 1000).cast("long").cast("string"),
                             F.lit("k€")).alias("bracket"), "count"))


def price_histogram(df: DataFrame, col: str = "prix", legacy_edge: bool = False) -> DataFrame:
    """Bins ``[lo, hi)`` of a data-driven step from 0, empty bins dropped,
    labels ``'lo-hik€'``.  ``legacy_edge`` reproduces the original upper edge:
    when ``int(max)`` is a multiple of the step, prices from ``int(max)`` fall
    in no bin; by default they go to the last bin."""
    s = scalars(df, lo=F.min(col), hi=F.max(col))
    return histogram_of(df, col, F.count(F.lit(1)), (s["lo"], s["hi"]), legacy_edge)


def dashboard(df: DataFrame, type_str: str = ALL_TYPES, region: str = ALL_REGIONS,
              metrics: dict | None = None) -> dict[str, DataFrame]:
    """B1: the dashboard panel parts for a type and a region; ``metrics``
    are the stored model metrics (S16), empty while nothing is trained."""
    metrics = metrics or {}
    f = panel_filter(df, type_str, region)
    return {"kpis": dashboard_kpis(f), "active_markets": active_markets(f, metrics.get("r2")),
            "type_cards": type_cards(f), "price_histogram": price_histogram(f),
            "model": metrics_display(df.sparkSession, metrics)}


# ------------------------------------------------------------------ B2
def analysis_stats(df: DataFrame) -> DataFrame:
    """Count, median, mean, min, max of the filtered prices."""
    return df.agg(F.count(F.lit(1)).alias("count"),
                  _whole(quantiles(df, "prix", [0.5])[0]).alias("median"),
                  trunc_long(exact_avg("prix")).alias("mean"),
                  trunc_long(F.min("prix")).alias("min"),
                  trunc_long(F.max("prix")).alias("max"))


QUARTILES = "bracket_order int, lo long, hi long, bracket string, pct int"


def quartile_rows(qs) -> list[tuple]:
    """A10: the four brackets cut at the truncated quartiles."""
    q25, q50, q75 = (int(q) for q in qs)

    def fmt(v):
        return f"{v:,}".replace(",", " ")
    return [(1, None, q25, f"< {fmt(q25)}€", 25),
            (2, q25, q50, f"{fmt(q25)}–{fmt(q50)}€", 25),
            (3, q50, q75, f"{fmt(q50)}–{fmt(q75)}€", 25),
            (4, q75, None, f"> {fmt(q75)}€", 25)]


def analysis_quartiles(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """A10: four price brackets cut at the truncated quartiles, 25 % each;
    empty unless more than ``min_rows`` rows.  Bounds are numeric (lo, hi)."""
    spark = df.sparkSession
    if df.limit(min_rows + 1).count() <= min_rows:
        return spark.createDataFrame([], QUARTILES)
    qs = quantiles(df, "prix", [0.25, 0.5, 0.75])
    return spark.createDataFrame([] if None in qs else quartile_rows(qs), QUARTILES)


def analysis_type_stats(df: DataFrame) -> DataFrame:
    """Per type count, median, min, max price and median price per m²,
    in fixed type order; types without rows are omitted."""
    if not any(TYPE_COL_MAP[t] in df.columns for t in STAT_TYPES):
        return df.sparkSession.createDataFrame(
            [], "type string, type_order int, count long, median long, prix_min long, "
                "prix_max long, prix_m2 long")
    base = [F.count(F.lit(1)).alias("count"),
            trunc_long(F.min("prix")).alias("prix_min"),
            trunc_long(F.max("prix")).alias("prix_max")]
    med, med_m2 = _type_medians(df, STAT_TYPES, F.col("prix"), _price_m2())
    agg = _per_type(df, STAT_TYPES, base).withColumns(
        {"median": _by_type(med), "prix_m2": _by_type(med_m2)})
    return (agg.select("type", "type_order", "count", "median", "prix_min", "prix_max", "prix_m2")
            .orderBy("type_order"))


def top_cities_m2(raw: DataFrame, type_str: str = ALL_TYPES, k: int = TOP_CITIES,
                  min_count: int = TOP_CITY_MIN_COUNT) -> DataFrame:
    """Cities by mean raw price per m² (rows with a positive surface,
    optional exact type filter, at least ``min_count`` rows), top ``k``;
    by mean price when there is no surface column."""
    r = raw.where(F.col("city").isNotNull() & F.col("price").isNotNull())
    if type_str and type_str != ALL_TYPES:
        r = r.where(F.col("type") == F.lit(type_str))
    if "surface" in r.columns:
        r = r.where(F.col("surface") > 0)
        value = F.col("price") / F.col("surface")
    else:
        value = F.col("price")
    stats = (r.groupBy("city").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("count"))
             .where(F.col("count") >= min_count))
    return (stats.orderBy(F.desc("mean"), "city").limit(k)
            .select("city", trunc_long("mean").alias("price"), "count"))


def analysis(df: DataFrame, raw: DataFrame, zone=ALL_CITIES, type_str=ALL_TYPES,
             smin=None, smax=None, rooms=ALL_ROOMS) -> dict[str, DataFrame]:
    """B2: filtered statistics; the top cities obey only the type filter."""
    f = panel_filter(df, type_str, zone=zone, smin=smin, smax=smax, rooms=rooms)
    return {"stats": analysis_stats(f), "quartiles": analysis_quartiles(f),
            "type_stats": analysis_type_stats(f), "top_cities": top_cities_m2(raw, type_str)}


# ------------------------------------------------------------------ B3
def city_frequency(raw: DataFrame, k: int = FREQUENT_CITIES) -> DataFrame:
    """The ``k`` most frequent cities (ties by name)."""
    return (raw.where(F.col("city").isNotNull()).groupBy("city")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "city").limit(k))


def city_labels(raw: DataFrame, k: int = FREQUENT_CITIES) -> DataFrame:
    """W3: 'city, zipcode' for the frequent cities, zipcode of the city's
    first row in file order.  Counts and first ordinals come from one hash
    aggregate; only the ``k`` rows that are wanted are then looked up."""
    top = (raw.where(F.col("city").isNotNull()).groupBy("city")
           .agg(F.count(F.lit(1)).alias("count"), F.min(ORDINAL).alias("_first"))
           .orderBy(F.desc("count"), "city").limit(k))
    first = raw.select(F.col("city").alias("_city"), F.col(ORDINAL).alias("_ordinal"), "zipcode")
    return (first.join(F.broadcast(top), (F.col("_city") == F.col("city"))
                       & (F.col("_ordinal") == F.col("_first")))
            .select("city", "count", F.concat_ws(", ", "city", "zipcode").alias("label")))


def option_lists(df: DataFrame, raw: DataFrame, k: int = FREQUENT_CITIES) -> DataFrame:
    """Dropdown options as ``(list, position, value)``: sentinel first,
    then sorted regions / frequent cities / fixed types and room buckets."""
    spark = raw.sparkSession
    # numbered per first letter, and shifted by the letters before it
    named = (raw.where(F.col("region").isNotNull()).groupBy("region").agg(F.lit(1).alias("one"))
             .select("region", F.substring("region", 1, 1).alias("letter")))
    before = named.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).select(
        "letter", (F.sum("n").over(Window.orderBy("letter")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("letter").orderBy("region"))
    regions = (named.join(before, "letter")
               .select(F.lit("regions").alias("list"),
                       (F.col("before") + place + 1).alias("position"),
                       F.col("region").alias("value")))
    cities = city_frequency(raw, k).agg(F.collect_list("city").alias("all")).select(
        F.lit("cities").alias("list"), F.posexplode("all").alias("position", "value")) \
        .withColumn("position", F.col("position") + 2)
    fixed = [("regions", 1, ALL_REGIONS), ("cities", 1, ALL_CITIES)]
    fixed += [("property_types", i + 1, t) for i, t in enumerate(PROPERTY_TYPES)]
    if "pieces" in df.columns:
        fixed += [("rooms", i + 1, r) for i, r in enumerate(ROOM_OPTIONS)]
    lit_rows = spark.createDataFrame(fixed, "list string, position int, value string")
    return (lit_rows.unionByName(regions.withColumn("position", F.col("position").cast("int")))
            .unionByName(cities.withColumn("position", F.col("position").cast("int"))))


def scoring_options(df: DataFrame, raw: DataFrame, k: int = FREQUENT_CITIES,
                    ranges: DataFrame | None = None) -> DataFrame:
    """Everything the scoring form offers, in one result ``(list,
    position, value)``: city labels, property types, input ranges (A18, those
    of ``df`` unless they are given)."""
    labels = (city_labels(raw, k).orderBy(F.desc("count"), "city")
              .agg(F.collect_list("label").alias("all"))
              .select(F.lit("cities").alias("list"), F.posexplode("all").alias("position", "value"))
              .withColumn("position", F.col("position") + 1))
    ranges = ranges if ranges is not None else input_ranges(df)
    offered = [("types", i + 1, F.lit(t)) for i, t in enumerate(PROPERTY_TYPES[1:])]
    offered += [("ranges", i + 1, F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
                for i, c in enumerate(ranges.columns)]
    fixed = ranges.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("list"), F.lit(i).alias("position"), value.alias("value"))
        for name, i, value in offered])))
    return fixed.unionByName(labels)


RANGES = "surface_min long, surface_max long, pieces_min long, pieces_max long"


def range_row(surface, pieces) -> tuple:
    """The truncated (q01, q99) of surface and rooms, defaults without values."""
    s = (int(surface[0]), int(surface[1])) if surface and surface[0] is not None \
        else SURFACE_RANGE_DEFAULT
    p = (PIECES_RANGE_DEFAULT[0], int(pieces[1])) if pieces and pieces[1] is not None \
        else PIECES_RANGE_DEFAULT
    return (*s, *p)


def input_ranges(df: DataFrame) -> DataFrame:
    """Surface q01-q99 and rooms 1-q99 (truncated), defaults when empty."""
    surface, pieces = quantile_table(df, [(F.col("surface"), None), (F.col("pieces"), None)],
                                     [0.01, 0.99])
    return df.sparkSession.createDataFrame([range_row(surface, pieces)], RANGES)


# ------------------------------------------------------------------ B4
def city_map(raw: DataFrame, coords: DataFrame | None = None, k: int = MAP_CITIES) -> DataFrame:
    """The ``k`` busiest cities with mean price, mean price per m²
    (over rows with a positive surface, truncated; 0 when none), a tier from
    the terciles of those values, and the volume rank; cities without
    coordinates are dropped after ranking (W2 keeps the gaps)."""
    coords = coords if coords is not None else coordinates(raw.sparkSession)
    r = raw.where(F.col("city").isNotNull() & F.col("price").isNotNull())
    has_surface = "surface" in r.columns
    m2 = F.avg(F.when(F.col("surface") > 0, F.col("price") / F.col("surface"))) \
        if has_surface else F.lit(None).cast("double")
    # the top-k (at most k rows) comes back once: terciles and ranks are
    # taken from it, then it is joined to the coordinates
    top_rows = (r.groupBy("city")
                .agg(exact_avg("price").alias("avg_price"), F.count(F.lit(1)).alias("count"),
                     m2.alias("m2"))
                .orderBy(F.desc("count"), "city").limit(k).collect())
    vals = sorted(int(x["m2"]) for x in top_rows if x["m2"] is not None)
    t1, t2 = (vals[len(vals) // 3], vals[2 * len(vals) // 3]) if vals else DEFAULT_TERCILES
    top = raw.sparkSession.createDataFrame(
        [(i + 1, x["city"], x["avg_price"], x["count"], x["m2"]) for i, x in enumerate(top_rows)],
        "id long, city string, avg_price double, count long, m2 double")
    avg_m2 = F.coalesce(trunc_long("m2"), F.lit(0))
    avg = trunc_long("avg_price")
    tier = F.when(avg_m2 <= t1, "cheap").when(avg_m2 <= t2, "mid").otherwise("expensive")
    # the top (at most ``k`` rows) is the side to broadcast, coordinates may be many
    return (F.broadcast(top).join(coords.select("city", "lat", "lng"), "city", "inner")
            .select(F.col("id").cast("long").alias("id"), "lat", "lng",
                    F.when(avg_m2 > 0, avg_m2).otherwise(avg).alias("weight"),
                    avg_m2.alias("price_m2"), "city",
                    spaced_thousands(F.when(avg_m2 > 0, avg_m2).otherwise(avg)).alias("price"),
                    F.concat(F.col("count").cast("string"), F.lit(" annonces")).alias("trend"),
                    tier.alias("tier"), "count",
                    (F.col("count") >= ACTIVE_COUNT).alias("active"))
            .orderBy("id"))


# ------------------------------------------------------------------ B5
def market_alerts(raw: DataFrame, k: int = ALERT_CITIES, min_count: int = ALERT_MIN_COUNT,
                  rank_error: float | None = None) -> DataFrame:
    """The ``k`` busiest cities (at least ``min_count`` rows with a
    positive surface) with mean price per m², its deviation from the
    national median in % (1 dp) and whether it lies above it (C18).  The median
    is exact unless a ``rank_error`` is accepted."""
    if "surface" not in raw.columns:
        return raw.sparkSession.createDataFrame(
            [], "zone string, current_price long, count long, vs_median_pct double, "
                "above_median boolean")
    r = (raw.where(F.col("city").isNotNull() & F.col("price").isNotNull()
                   & (F.col("surface") > 0))
         .withColumn("prix_m2", F.col("price") / F.col("surface")))
    med = quantiles(r, "prix_m2", [0.5], rank_error)[0]
    stats = (r.groupBy("city").agg(F.avg("prix_m2").alias("mean"),
                                   F.count(F.lit(1)).alias("count"))
             .where(F.col("count") >= min_count)
             .orderBy(F.desc("count"), "city").limit(k))
    return stats.select(F.col("city").alias("zone"), trunc_long("mean").alias("current_price"),
                        "count",
                        F.round((F.col("mean") - F.lit(med)) / F.lit(med) * 100, 1)
                        .alias("vs_median_pct")) \
        .withColumn("above_median", F.col("vs_median_pct") > 0)


# ------------------------------------------------------------------ B6
def run_counts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw and clean row counts, dropped = max(raw - clean, 0), and the
    80/20 train/test sizes (truncated)."""
    # one pass over both inputs: tag rows, then a single global aggregate
    tagged = raw.select(F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        clean.select(F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = tagged.agg(F.sum("r").cast("long").alias("raw_count"),
                        F.sum("c").cast("long").alias("clean_count"))
    return counts.select(
        F.coalesce("raw_count", F.lit(0)).alias("raw_count"),
        F.coalesce("clean_count", F.lit(0)).alias("clean_count"),
        F.greatest(F.coalesce(F.col("raw_count") - F.col("clean_count"), F.lit(0)), F.lit(0))
        .alias("dropped"),
        trunc_long(F.coalesce("clean_count", F.lit(0)) * 0.8).alias("train"),
        trunc_long(F.coalesce("clean_count", F.lit(0)) * 0.2).alias("test"))


def metrics_display(spark, metrics: dict) -> DataFrame:
    """Stored model metrics as panel text (``mae`` and ``rmse``
    rounded with spaced thousands, ``r2`` as stored, ``r2_pct`` with 1 dp);
    nulls when no model was trained."""
    def spaced(v):
        return f"{int(round(float(v))):,}".replace(",", " ") if v is not None else None
    r2 = metrics.get("r2")
    row = (spaced(metrics.get("mae")), spaced(metrics.get("rmse")),
           str(r2) if r2 is not None else None,
           f"{float(r2) * 100:.1f}" if r2 is not None else None, metrics.get("method"))
    return spark.createDataFrame([row], "mae string, rmse string, r2 string, r2_pct string, "
                                        "method string")


def run_report(raw: DataFrame, clean: DataFrame, metrics: dict, model=None) -> dict[str, DataFrame]:
    """Row counts and split sizes (A17), model metrics (S16) and, when a
    fitted model is given, its boosting settings (M15)."""
    from immolens.operators.models import hyperparameters
    spark = raw.sparkSession
    out = {"counts": run_counts(raw, clean), "metrics": metrics_display(spark, metrics)}
    if model is not None:
        out["hyperparameters"] = hyperparameters(spark, model)
    return out
