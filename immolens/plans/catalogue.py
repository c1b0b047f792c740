"""Query catalogue: one ``(spark, sf_dir) -> DataFrame`` per operator family.

Every query reads the driver tables through the listing adapter, so its
work grows with the scale factor; nothing is sampled or capped except where
a top-k is the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from immolens.operators import (boosting, bundle, clean, cube, features, market, marts, models,
                                quality, scoring, warehouse)
from immolens.operators.keys import keep_first
from immolens.plans import views
from immolens.sources.adapter import city_coordinates
from immolens.sources.adapter import listings_snapshot as listings
from immolens.sources.snapshots import stored, stored_folder

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOGUE[fn.__name__] = fn
    return fn


def _star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """M19 written as five stored tables (dimensions first, then the fact
    from the stored dimensions), like the warehouse the marts read."""
    lp = warehouse.prepare_raw(listings(spark, sf_dir))
    dims = {name: stored(spark, name, sf_dir, lambda fn=fn: fn(lp))
            for name, fn in (("dim_type", warehouse.dim_type),
                             ("dim_location", warehouse.dim_location),
                             ("dim_author", warehouse.dim_author),
                             ("dim_date", warehouse.dim_date))}
    fact = stored(spark, "fact_ads", sf_dir, lambda: warehouse.fact_ads(
        lp, dims["dim_type"], dims["dim_location"], dims["dim_date"]))
    return {**dims, "fact_ads": fact}


# --------------------------------------------------------------- warehouse
@query
def city_mart(spark, sf_dir):
    return marts.city_mart(_star(spark, sf_dir))


@query
def region_type_mart(spark, sf_dir):
    return marts.region_type_mart(_star(spark, sf_dir))


@query
def monthly_mart(spark, sf_dir):
    return marts.monthly_mart(_star(spark, sf_dir))


def _mart_view(spark, sf_dir, view):
    """A mart read through Spark SQL, as a view over the registered star tables."""
    for name, df in _star(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
    views.create_mart_views(spark)
    return spark.sql(f"SELECT * FROM {view}")


@query
def city_mart_sql(spark, sf_dir):
    return _mart_view(spark, sf_dir, "dm_stats_par_ville")


@query
def region_type_mart_sql(spark, sf_dir):
    return _mart_view(spark, sf_dir, "dm_stats_region_type")


@query
def monthly_mart_sql(spark, sf_dir):
    return _mart_view(spark, sf_dir, "dm_stats_mensuelles")


@query
def dim_type(spark, sf_dir):
    return _star(spark, sf_dir)["dim_type"]


@query
def dim_location(spark, sf_dir):
    return _star(spark, sf_dir)["dim_location"]


@query
def dim_author(spark, sf_dir):
    return _star(spark, sf_dir)["dim_author"]


@query
def dim_date(spark, sf_dir):
    return _star(spark, sf_dir)["dim_date"]


@query
def fact_listings(spark, sf_dir):
    return _star(spark, sf_dir)["fact_ads"]


@query
def integrity_audit(spark, sf_dir):
    return warehouse.integrity_audit(_star(spark, sf_dir))


def _hashed_star(spark, sf_dir):
    """M19 with keys by hash: the fact is built without a join."""
    star = warehouse.build_star(listings(spark, sf_dir), "hash")
    return {name: stored(spark, f"hashed_{name}", sf_dir, lambda df=df: df)
            for name, df in star.items()}


@query
def integrity_audit_hash_keys(spark, sf_dir):
    """F13 over hash keys: two natural keys that meet would be a violation."""
    return warehouse.integrity_audit(_hashed_star(spark, sf_dir))


@query
def city_mart_hash_keys(spark, sf_dir):
    return marts.city_mart(_hashed_star(spark, sf_dir))


@query
def region_type_mart_parts(spark, sf_dir):
    """A4 from stored parts, merged at read."""
    star = _star(spark, sf_dir)
    parts = stored(spark, "mart_parts", sf_dir, lambda: marts.fact_parts(star["fact_ads"]))
    return marts.region_type_mart({**star, "mart_parts": parts})


# ------------------------------------------------------------ preparation



def _raw(spark, sf_dir):
    return listings(spark, sf_dir)


def _quality(spark, sf_dir):
    return quality.data_quality(_raw(spark, sf_dir))


def _clean(spark, sf_dir):
    """The cleaned rows, written once per snapshot: what follows reads them
    several times."""
    return stored(spark, "clean", sf_dir, lambda: clean.clean_listings(
        _quality(spark, sf_dir), store=_store(spark, sf_dir, "clean")))


def _trimmed(spark, sf_dir):
    c = _clean(spark, sf_dir)
    return features.remove_outliers(c.where(F.col("prix").isNotNull()))


def _features(spark, sf_dir):
    """M7 without the clustering stage (clusters are checked separately)."""
    out, _, _ = features.engineer_features(_clean(spark, sf_dir), n_cluster=None)
    return out


@query
def title_extraction(spark, sf_dir):
    return quality.extract_m2(_raw(spark, sf_dir)).select(
        "id", "ordinal", "type", "surface", "pieces", "price_m2")


@query
def quality_filter(spark, sf_dir):
    return _quality(spark, sf_dir)


@query
def quality_rule_counts(spark, sf_dir):
    return quality.rule_counts(_raw(spark, sf_dir))


@query
def rejected_rows(spark, sf_dir):
    return quality.rejected_rows(_raw(spark, sf_dir))


@query
def numeric_clean(spark, sf_dir):
    """C1 on text renderings of the listing numbers ('112 946,50 €', '45,5 m2')."""
    raw = _raw(spark, sf_dir)
    txt = raw.select(
        "id", "ordinal",
        F.concat(F.translate(F.format_number("price", 2), ",.", " ,"), F.lit("\u00a0€"))
         .alias("prix_txt"),
        F.concat(F.col("surface").try_cast("long").cast("string"), F.lit(",5 m2")).alias("surface_txt"),
        F.concat(F.lit(" "), F.col("pieces").try_cast("long").cast("string"), F.lit(" pièces"))
         .alias("pieces_txt"))
    parsed = clean.clean_numerical_columns(
        txt.withColumns({"prix": F.col("prix_txt"), "surface": F.col("surface_txt"),
                         "pieces": F.col("pieces_txt")}),
        ["prix", "surface", "pieces"])
    return parsed


@query
def text_normalise(spark, sf_dir):
    raw = _raw(spark, sf_dir).select(
        "id", "ordinal", F.col("city").alias("ville"), F.col("type").alias("type_bien"))
    return clean.normalize_text_columns(raw)


@query
def contact_hash(spark, sf_dir):
    raw = _raw(spark, sf_dir).select("id", "ordinal", F.col("author").alias("agence"))
    return clean.hash_contact_names(raw)


@query
def dedupe_first(spark, sf_dir):
    return keep_first(_raw(spark, sf_dir), "id")


@query
def mean_impute(spark, sf_dir):
    raw = _raw(spark, sf_dir).select("id", "ordinal", "price", "surface", "pieces")
    return clean.impute_missing_values(raw, "mean")


@query
def clean_listings(spark, sf_dir):
    return _clean(spark, sf_dir)


@query
def outlier_trim(spark, sf_dir):
    return _trimmed(spark, sf_dir)


@query
def target_encoding(spark, sf_dir):
    return _encoding(spark, sf_dir)


def _encoding(spark, sf_dir):
    return stored(spark, "encoding", sf_dir,
                  lambda: features.fit_target_encoding(_trimmed(spark, sf_dir)))


@query
def target_encode_apply(spark, sf_dir):
    """M4: the saved encoding applied to raw city names (upper-cased lookup);
    unknown or missing cities get the unweighted mean of the encodings."""
    enc = _encoding(spark, sf_dir)
    raw = _raw(spark, sf_dir).select("id", "ordinal", F.col("city").alias("ville"))
    return features.apply_target_encoding(raw, enc, "ville", on_unknown="default",
                                          normalise=True)


@query
def features_table(spark, sf_dir):
    """M7: the whole ML-ready row but the cluster (logs to 8 decimals)."""
    f = _features_table(spark, sf_dir)
    return f.withColumns({c: F.round(c, 8) for c in ("prix_log", "surface_log")})


@query
def one_hot(spark, sf_dir):
    f = _features_table(spark, sf_dir)
    return f.select("id_annonce", *[c for c in f.columns if c.startswith("type_bien_")])


@query
def log_features(spark, sf_dir):
    f = _features_table(spark, sf_dir)
    return f.select("id_annonce", F.round("prix_log", 8).alias("prix_log"),
                    F.round("surface_log", 8).alias("surface_log"))


# ------------------------------------------------------------------ market

# Fixed panel parameters used by the filtered catalogue variants.
FILTERED_DASHBOARD = dict(type_str="Maison", region="EUROPE")
FILTERED_ANALYSIS = dict(type_str="Appartement", smin="50", smax="150", rooms="3-4 pièces")
ZONE_ANALYSIS = dict(zone="NATION_1_BUILDING")
ROOMS_ANALYSIS = dict(type_str="Maison", rooms="3-4 pièces")


def _features_table(spark, sf_dir):
    """The ML-ready table the preparation job writes (read by the panels)."""
    return stored(spark, "features", sf_dir, lambda: _features(spark, sf_dir))


def _market(spark, sf_dir):
    """Panel input: stored ML-ready rows with region and city joined back."""
    return stored(spark, "market", sf_dir, lambda: market.enrich_by_id(
        _features_table(spark, sf_dir), _raw(spark, sf_dir)))


def _cube(spark, sf_dir) -> cube.PanelCube:
    """The panel cube the preparation job writes beside the ML-ready table."""
    return cube.PanelCube.build(_market(spark, sf_dir),
                                lambda name, make: stored(spark, name, sf_dir, make))


@query
def dashboard_kpis(spark, sf_dir):
    return _cube(spark, sf_dir).dashboard_kpis()


@query
def dashboard_kpis_filtered(spark, sf_dir):
    return _cube(spark, sf_dir).dashboard_kpis(**FILTERED_DASHBOARD)


@query
def active_markets(spark, sf_dir):
    return _cube(spark, sf_dir).active_markets()


@query
def active_markets_filtered(spark, sf_dir):
    return _cube(spark, sf_dir).active_markets(**FILTERED_DASHBOARD)


@query
def type_cards(spark, sf_dir):
    return _cube(spark, sf_dir).type_cards()


@query
def type_cards_filtered(spark, sf_dir):
    return _cube(spark, sf_dir).type_cards(**FILTERED_DASHBOARD)


@query
def price_histogram(spark, sf_dir):
    return _cube(spark, sf_dir).price_histogram()


@query
def price_histogram_legacy(spark, sf_dir):
    return _cube(spark, sf_dir).price_histogram(legacy_edge=True)


@query
def price_histogram_filtered(spark, sf_dir):
    return _cube(spark, sf_dir).price_histogram(**FILTERED_DASHBOARD)


@query
def analysis_stats(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_stats()


@query
def analysis_type_stats(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_type_stats()


@query
def analysis_quartiles(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_quartiles()


@query
def analysis_zone(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_stats(**ZONE_ANALYSIS)


@query
def analysis_quartiles_zone(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_quartiles(**ZONE_ANALYSIS)


@query
def analysis_type_stats_zone(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_type_stats(**ZONE_ANALYSIS)


@query
def analysis_rooms(spark, sf_dir):
    return _cube(spark, sf_dir).analysis_stats(**ROOMS_ANALYSIS)


# with surface bounds: from the rows
@query
def analysis_filtered(spark, sf_dir):
    return market.analysis_stats(market.panel_filter(_market(spark, sf_dir), **FILTERED_ANALYSIS))


@query
def analysis_quartiles_filtered(spark, sf_dir):
    return market.analysis_quartiles(
        market.panel_filter(_market(spark, sf_dir), **FILTERED_ANALYSIS))


@query
def analysis_type_stats_filtered(spark, sf_dir):
    return market.analysis_type_stats(
        market.panel_filter(_market(spark, sf_dir), **FILTERED_ANALYSIS))


@query
def scoring_options(spark, sf_dir):
    return market.scoring_options(_features_table(spark, sf_dir), _raw(spark, sf_dir),
                                  ranges=_cube(spark, sf_dir).input_ranges())


@query
def room_buckets(spark, sf_dir):
    m = _market(spark, sf_dir)
    return m.groupBy(market.room_bucket("pieces").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"))


@query
def top_cities_m2(spark, sf_dir):
    return market.top_cities_m2(_raw(spark, sf_dir))


@query
def top_cities_m2_type(spark, sf_dir):
    return market.top_cities_m2(_raw(spark, sf_dir), "Maison")


@query
def city_frequency(spark, sf_dir):
    return market.city_frequency(_raw(spark, sf_dir))


@query
def option_lists(spark, sf_dir):
    return market.option_lists(_market(spark, sf_dir), _raw(spark, sf_dir))


@query
def city_labels(spark, sf_dir):
    return market.city_labels(_raw(spark, sf_dir))


@query
def city_map(spark, sf_dir):
    return market.city_map(_raw(spark, sf_dir), city_coordinates(spark, sf_dir))


@query
def market_alerts(spark, sf_dir):
    return market.market_alerts(_raw(spark, sf_dir))


@query
def run_counts(spark, sf_dir):
    return market.run_counts(_raw(spark, sf_dir), _features_table(spark, sf_dir))


@query
def stage_audit(spark, sf_dir):
    """Rows in and out of every preparation stage (one row per stage)."""
    # one pass over the raw rows gives two of the counts; the others are those
    # of the stored stages
    first = quality.rule_counts(_raw(spark, sf_dir))
    one = F.count(F.lit(1))
    counts = (first.select(F.col("rows_in").alias("ingest"), F.col("rows_out").alias("quality"))
              .crossJoin(_clean(spark, sf_dir).agg(one.alias("clean")))
              .crossJoin(_features_table(spark, sf_dir).agg(one.alias("features"))))
    names = ["ingest", "quality", "clean", "features"]
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"),
                 F.col(names[max(0, i - 1)]).alias("rows_in"), F.col(name).alias("rows_out"),
                 (F.col(names[max(0, i - 1)]) - F.col(name)).alias("dropped"))
        for i, name in enumerate(names)])))


@query
def input_ranges(spark, sf_dir):
    return _cube(spark, sf_dir).input_ranges()


@query
def enrich_by_id(spark, sf_dir):
    return market.enrich_by_id(_features_table(spark, sf_dir), _raw(spark, sf_dir)).select(
        "id_annonce", "region", "city")


@query
def median_label(spark, sf_dir):
    labelled, _ = models.median_label(_features_table(spark, sf_dir))
    return labelled.select("id_annonce", "prix", "label")


@query
def regression_metrics(spark, sf_dir):
    """A23 on a deterministic predictor: the smoothed city mean (``ville``)."""
    f = _features_table(spark, sf_dir)
    return models.regression_metrics(f, "prix", "ville")


@query
def classification_metrics(spark, sf_dir):
    """A24 on a deterministic predictor: is the city encoding above the
    median price?"""
    labelled, med = models.median_label(_features_table(spark, sf_dir))
    pred = labelled.withColumn("prediction", (F.col("ville") > F.lit(med)).cast("int"))
    return models.classification_metrics(pred, "label", "prediction")


@query
def projections(spark, sf_dir):
    return scoring.projections(_clean(spark, sf_dir), "prix", keys=["id_annonce"])


# ---------------------------------------------- what is fixed around the models
# Fixed values of the checks: centres in (surface, rooms), a trained R².
CENTRES = [(40.0, 2.0), (90.0, 3.0), (150.0, 4.0), (220.0, 6.0)]
CHECKED_R2 = 0.75


def _requests(spark, sf_dir):
    """Every raw listing, after the title repair, as a scoring request."""
    return quality.extract_m2(_raw(spark, sf_dir)).select(
        "id", "ordinal",
        F.concat_ws(", ", "city", "zipcode").alias("city"),
        F.col("type").alias("property_type"),
        F.col("surface").alias("surface_area"),
        F.coalesce(F.col("pieces"), F.lit(0)).cast("int").alias("rooms"))


@query
def request_features(spark, sf_dir):
    """The model's inputs for every request."""
    f = _features_table(spark, sf_dir)
    flags = [x for x in f.columns if x.startswith("type_bien_")]
    ranges = _cube(spark, sf_dir).input_ranges().first().asDict()
    out = scoring.request_features(scoring.clamp_requests(_requests(spark, sf_dir), ranges),
                                   _encoding(spark, sf_dir), flags)
    return out.select("id", "ordinal", "ville", "surface", "pieces",
                      F.round("surface_log", 8).alias("surface_log"), *flags)


@query
def train_test_split(spark, sf_dir):
    """M8: the set of every id."""
    train, test = models.split(_features_table(spark, sf_dir).select("id_annonce"))
    return (train.withColumn("test", F.lit(False))
            .unionByName(test.withColumn("test", F.lit(True))))


@query
def nearest_centres(spark, sf_dir):
    """M6: the cluster of every listing for given centres."""
    given = models.Clusters(["surface", "pieces"], CENTRES)
    return models.predict_cluster(_features_table(spark, sf_dir), given).select(
        "id_annonce", "cluster")


@query
def importance_shares(spark, sf_dir):
    """Shares, labels and order of given weights (how often a
    flag is set, how many features are there)."""
    f = _features_table(spark, sf_dir)
    flags = [x for x in f.columns if x.startswith("type_bien_")]
    counts = f.agg(*[F.count_if(F.col(x)).cast("double").alias(x) for x in flags],
                   F.count(F.lit(1)).cast("double").alias("surface"))
    weights = counts.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("feature"), F.col(x).alias("weight")) for x in counts.columns])))
    return models.importance_shares(weights)


@query
def score_figures(spark, sf_dir):
    """M16, C17, M17 for given predictions (the mean price of the request's
    city): figures and projections, from the untruncated price."""
    requests = _requests(spark, sf_dir)
    given = features.apply_target_encoding(
        requests.select("ordinal", F.split_part("city", F.lit(","), F.lit(1)).alias("ville")),
        _encoding(spark, sf_dir), "ville", on_unknown="default", normalise=True)
    priced = requests.join(given.select("ordinal", "ville"), "ordinal")
    price = F.col("ville")
    return priced.select("ordinal", *scoring.figures(price, F.col("surface_area"), CHECKED_R2),
                         *scoring.horizon_prices(price))


# ------------------------------------------------------------ model jobs
_TRAINED: dict[tuple, dict] = {}
_BUNDLES: dict[tuple, str] = {}


def _clustered(spark, sf_dir):
    """M5 and M7: the ML-ready rows with their cluster, as training reads them."""
    found = {}

    def build():
        out, found["model"] = models.train_clustering(_features_table(spark, sf_dir), 8)
        return out

    rows = stored(spark, "clustered", sf_dir, build)
    return rows, found.get("model")


def _trained(spark, sf_dir) -> dict:
    """The three models at their full size, fitted once per application and
    snapshot on rows with a cluster; the queries below read what came out."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        rows, km = _clustered(spark, sf_dir)
        km = km or models.fit_clustering(_features_table(spark, sf_dir), 8)
        _TRAINED[key] = {**models.train_models(rows), "kmeans": km}
    return _TRAINED[key]


@query
def clusters(spark, sf_dir):
    return _clustered(spark, sf_dir)[0].select("id_annonce", "cluster")


@query
def price_models(spark, sf_dir):
    return models.results_frame(spark, _trained(spark, sf_dir))


@query
def price_regression(spark, sf_dir):
    """Both regressions' test metrics."""
    return price_models(spark, sf_dir).where(F.col("model").startswith("regression"))


@query
def price_classification(spark, sf_dir):
    """The above-median classifier's test metrics."""
    return price_models(spark, sf_dir).where(F.col("model") == "classification")


@query
def champion(spark, sf_dir):
    """The better regression by R² and its metrics."""
    return price_models(spark, sf_dir).where(F.col("model") == "champion")


@query
def feature_importance(spark, sf_dir):
    res = _trained(spark, sf_dir)
    return models.feature_importance(spark, res["champion"]["model"], res["feature_columns"])


@query
def hyperparameters(spark, sf_dir):
    """M15, with the number of trees and nodes that the data gave the champion."""
    model = _trained(spark, sf_dir)["champion"]["model"]
    return models.hyperparameters(spark, model).withColumns(
        {"trees": F.lit(model.getNumTrees), "nodes": F.lit(model.totalNumNodes)})


def _bundle(spark, sf_dir) -> bundle.Bundle:
    """The stored bundle of the training, published once per application and
    snapshot and loaded back from its folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUNDLES:
        res = _trained(spark, sf_dir)
        ranges = _cube(spark, sf_dir).input_ranges().first().asDict()
        clusters = models.Clusters.of_model(res["kmeans"])
        root = stored_folder(spark, "bundle", sf_dir)
        bundle.save(spark, root, bundle.of_training(res, _encoding(spark, sf_dir), clusters, ranges))
        _BUNDLES[key] = root
    return bundle.load(spark, _BUNDLES[key])


@query
def batch_scoring(spark, sf_dir):
    """M16 over every raw listing turned into a request ('city, zipcode',
    type, surface, rooms), scored from the stored bundle alone."""
    return bundle.score(_requests(spark, sf_dir), _bundle(spark, sf_dir))


# ------------------------------------------------- second-order boosting
# Of the tree that SQL repeats.
CHECKED_TREE = boosting.Settings("prix", trees=1, depth=2, rows=1.0, columns=1.0, l2=1.0)
CHECKED_BINS = 8


def _store(spark, sf_dir, name):
    return lambda part, make: stored(spark, f"{name}-{part}", sf_dir, make)


def _boosted(spark, sf_dir) -> dict:
    key = (spark.sparkContext.applicationId, sf_dir, "second order")
    if key not in _TRAINED:
        rows, _ = _clustered(spark, sf_dir)
        _TRAINED[key] = boosting.train_prices(rows, _store(spark, sf_dir, "second"))
    return _TRAINED[key]


@query
def second_order_models(spark, sf_dir):
    """M9-M12, A23, A24 by second-order boosting, on the split of ``price_models``."""
    return models.results_frame(spark, _boosted(spark, sf_dir))


@query
def second_order_importance(spark, sf_dir):
    """Shares of the champion's gains."""
    champion = _boosted(spark, sf_dir)["champion"]["model"]
    return models.importance_shares(champion.importance(spark))


@query
def boosted_first_tree(spark, sf_dir):
    """M9: the first tree over all listings, on few bins: splits and leaves."""
    f = _features_table(spark, sf_dir)
    columns = sorted(models.feature_columns(f))
    model = boosting.fit(f, columns, {"first": CHECKED_TREE}, "id_annonce",
                         _store(spark, sf_dir, "first"), CHECKED_BINS)["first"]
    return boosting.splits(spark, model).select(
        "node", "feature", F.round("cut", 6).alias("cut"), F.round("value", 2).alias("value"))
