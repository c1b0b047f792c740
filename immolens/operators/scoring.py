"""Batch scoring (M16) and price projections.

The reference scores one request at a time; here a DataFrame of requests is
scored in one distributed pass: city lookup (a join on the encoding table),
type flags, cluster, model prediction, derived figures.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from immolens.functions.numeric import trunc_long
from immolens.functions.text import city_from_label, strip_upper
from immolens.operators.features import apply_target_encoding
from immolens.operators.models import predict_cluster

# Yearly price growth used for projections, and the horizons.
ANNUAL_RATE = 0.035
HORIZONS = [
    ("6 mois", 1 + ANNUAL_RATE / 2, f"+{ANNUAL_RATE / 2 * 100:.1f}%"),
    ("1 an", 1 + ANNUAL_RATE, f"+{ANNUAL_RATE * 100:.1f}%"),
    ("2 ans", (1 + ANNUAL_RATE) ** 2, f"+{((1 + ANNUAL_RATE) ** 2 - 1) * 100:.1f}%"),
]
TODAY = "Auj."
FLAG = "type_bien_"


def clamp_requests(requests: DataFrame, ranges: dict) -> DataFrame:
    """Bring surface and rooms into the accepted input ranges (A18),
    ``{'surface_min', 'surface_max', 'pieces_min', 'pieces_max'}``."""
    def clamp(c, lo, hi):
        return F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
    return requests.withColumns({
        "surface_area": clamp("surface_area", ranges["surface_min"], ranges["surface_max"])
        .cast(requests.schema["surface_area"].dataType),
        "rooms": clamp("rooms", ranges["pieces_min"], ranges["pieces_max"])
        .cast(requests.schema["rooms"].dataType)})


def request_features(requests: DataFrame, encoding: DataFrame, flags: list[str],
                     default_encoding: float | None = None) -> DataFrame:
    """C15, J6 + A19, C16 (rooms <= 0 -> 1), P7 and type flags for a frame of
    requests ``(city, property_type, surface_area, rooms)``.

    ``flags`` are the trained ``type_bien_*`` columns; a type that none of
    them stands for, or none at all, leaves them all false."""
    r = requests.withColumns({
        "ville": city_from_label("city"),
        "surface": F.col("surface_area").cast("double"),
        "pieces": F.when(F.col("rooms") > 0, F.col("rooms")).otherwise(F.lit(1)).cast("double"),
        "surface_log": F.log1p(F.col("surface_area").cast("double")),
        "_type": strip_upper("property_type"),
    })
    r = r.withColumns({f: F.coalesce(F.col("_type") == F.lit(f.removeprefix(FLAG)), F.lit(False))
                       for f in flags}).drop("_type")
    return apply_target_encoding(r, encoding, "ville", on_unknown="default",
                                 default=default_encoding)


def figures(price: Column, surface: Column, r2: float | None = None) -> list[Column]:
    """The reported figures of an untruncated price: whole price, confidence (the
    model's R² in %), price per m²."""
    return [trunc_long(price).alias("current_estimated_price"),
            (F.round(F.lit(r2 * 100), 1) if r2 is not None else F.lit(None).cast("double"))
            .alias("confidence"),
            trunc_long(F.try_divide(price, surface)).alias("price_per_sqm")]


def score(requests: DataFrame, encoding: DataFrame, clusters, model,
          feature_cols: list[str], method: str = "prix_brut", r2: float | None = None,
          default_encoding: float | None = None, ranges: dict | None = None) -> DataFrame:
    """Estimated price, price per m² and confidence for every request.

    ``model`` is the champion, alone or behind its assembler; ``clusters`` the
    fitted clustering or its centres (None: trained without).  ``ranges`` (the A18
    input ranges) clamps surface and rooms first."""
    if ranges:
        requests = clamp_requests(requests, ranges)
    flags = [c for c in feature_cols if c.startswith(FLAG)]
    # the requests' own columns are kept aside: a feature may have the name of one
    kept = requests.withColumns({f"_keep_{c}": F.col(c) for c in requests.columns})
    feats = request_features(kept, encoding, flags, default_encoding)
    if clusters is None:
        feats = feats.withColumn("cluster", F.lit(None).cast("int"))
    else:
        feats = predict_cluster(feats, clusters)
    ready = feats.withColumns({c: F.col(c).cast("double") for c in feature_cols})
    if not isinstance(model, PipelineModel):
        model = PipelineModel([VectorAssembler(inputCols=feature_cols, outputCol="features"), model])
    pred = model.transform(ready)
    price = F.expm1("prediction") if method == "log_prix" else F.col("prediction")
    return pred.select(*[F.col(f"_keep_{c}").alias(c) for c in requests.columns],
                       price.alias("predicted_price"),
                       *figures(price, F.col("_keep_surface_area"), r2), F.col("cluster"))


def horizon_prices(price: Column) -> list[Column]:
    """M17 side by side: the whole price at each horizon."""
    return [trunc_long(price * F.lit(factor)).alias(f"price_{i + 1}")
            for i, (_, factor, _) in enumerate(HORIZONS)]


def projections(df: DataFrame, price_col: str, keys=(), include_today: bool = True) -> DataFrame:
    """Long form ``(period, price, pct)``, one row per horizon (and today);
    ``price_col`` is the untruncated price (``predicted_price`` of ``score``)."""
    p = F.col(price_col)
    items = [F.struct(F.lit(name).alias("period"), price.alias("price"),
                      F.lit(label).alias("pct"))
             for (name, _, label), price in zip(HORIZONS, horizon_prices(p), strict=True)]
    if include_today:
        items.insert(0, F.struct(F.lit(TODAY).alias("period"), trunc_long(p).alias("price"),
                                 F.lit(None).cast("string").alias("pct")))
    return (df.select(*keys, F.explode(F.array(*items)).alias("_p"))
            .select(*keys, "_p.period", "_p.price", "_p.pct"))
