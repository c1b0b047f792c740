"""Clustering, boosted-tree models and their evaluation.

Fitting gives MLlib models; metrics are DataFrame aggregates.  KMeans is
MLlib's.  Its GBT, first-order gradient boosting with per-node feature
sampling, is grown over cells of equal rows (``first_order``), or by MLlib
itself where there are too many of them; the reference's booster is
second-order and regularised, so model quality figures are comparable in
kind, not equal.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from immolens.operators import first_order
from immolens.operators.stats import quantiles
from immolens.session import checkpoint_dir

# Model settings.
CLUSTER_COLUMNS = ["surface_log", "pieces", "type_bien_APPARTEMENT", "type_bien_MAISON",
                   "type_bien_TERRAIN"]
SPLIT_SEED = 42
TEST_FRACTION_BUCKETS = 5          # one bucket of five = 20 % test rows
REGRESSION_RAW = dict(maxIter=200, stepSize=0.1, maxDepth=7, subsamplingRate=0.8,
                      featureSubsetStrategy="0.8", seed=42)
REGRESSION_LOG = dict(REGRESSION_RAW, maxIter=300)
CLASSIFIER = dict(maxIter=200, stepSize=0.1, maxDepth=6, seed=42)
# MLlib's own fit cuts its lineage every 10 iterations (checkpoints into the
# shared spark.checkpoint.dir).
TRAINING_RUNTIME = dict(checkpointInterval=10)
FEATURE_LABELS = {
    "ville": "Ville (Target Encoded)",
    "surface": "Surface (m²)",
    "pieces": "Nb pièces",
    "type_bien_APPARTEMENT": "Appartement",
    "type_bien_MAISON": "Maison",
    "type_bien_TERRAIN": "Terrain",
    "type_bien_AUTRE": "Autre",
    "type_bien_PARKING": "Parking",
}


def _doubles(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ------------------------------------------------------------------ KMeans
@dataclass
class Clusters:
    """M5 as plain data: the columns that were clustered, and the centres in order.

    Cluster ids are places in the list, which is sorted, so they are the same for the
    same centres whatever number the fit gave them."""
    columns: list[str]
    centres: list[list[float]]

    @classmethod
    def of_model(cls, model: PipelineModel) -> Clusters:
        centres = [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]
        return cls(list(model.stages[0].getInputCols()), sorted(centres))


def fit_clustering(df: DataFrame, n_cluster: int = 8, cols=None, seed: int = 42) -> PipelineModel:
    """M5: ``VectorAssembler`` + ``KMeans(k, seed)`` on the given columns, by
    default those of ``CLUSTER_COLUMNS`` that there are (a type that no listing
    has gives no flag)."""
    cols = list(cols or [c for c in CLUSTER_COLUMNS if c in df.columns])
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_cluster_features"),
        KMeans(k=n_cluster, seed=seed, featuresCol="_cluster_features",
               predictionCol="_cluster"),
    ])
    return pipe.fit(_doubles(df.select(*cols), cols))


def predict_cluster(df: DataFrame, clusters: PipelineModel | Clusters) -> DataFrame:
    """M6: add ``cluster``, the index of the nearest centre (the first of equally
    near ones), for a fitted or reloaded model or its plain centres; a row
    without one of the clustered values has none."""
    own = Clusters.of_model(clusters) if isinstance(clusters, PipelineModel) else clusters
    values = [F.col(c).cast("double") for c in own.columns]
    far = [sum(((v - F.lit(float(x))) ** 2 for v, x in zip(values, centre, strict=True)), F.lit(0.0))
           for centre in own.centres]
    near = (F.array_position(F.array(*far), F.least(*far)) - 1).cast("int") if len(far) > 1 \
        else F.lit(0)
    known = [v.isNotNull() for v in values]
    return df.withColumn("cluster", F.when(reduce(lambda a, b: a & b, known), near))


def train_clustering(df: DataFrame, n_cluster: int = 8, cols=None, seed: int = 42):
    model = fit_clustering(df, n_cluster, cols, seed)
    return predict_cluster(df, model), model


# ------------------------------------------------------------------ split
def in_test_set(key: str = "id_annonce", seed: int = SPLIT_SEED) -> Column:
    """M8: whether a row is in the test set, by the md5 of seed and key, a digest
    that any SQL engine has.  A null key counts as the empty text."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return bucket % TEST_FRACTION_BUCKETS == 0


def split(df: DataFrame, key: str = "id_annonce", seed: int = SPLIT_SEED):
    """M8: deterministic 80/20 split by a digest of the key.

    The same rows land in the test set for every model and every partition
    layout (``randomSplit`` depends on the partitioning of its input).
    """
    test = in_test_set(key, seed)
    return df.where(~test), df.where(test)


def feature_columns(df: DataFrame, exclude=("prix", "prix_log", "id_annonce", "label")) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in exclude]


def _assembled(df: DataFrame, cols) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(_doubles(df, cols))


# ------------------------------------------------------------------ metrics
def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       use_log: bool = False) -> DataFrame:
    """MAE and RMSE (2 dp), R² (4 dp), after ``expm1`` for log targets.

    One aggregate pass: the total is the label's variance times the count.
    """
    y, p = F.col(label), F.col(prediction)
    if use_log:
        y, p = F.expm1(y), F.expm1(p)
    d = pred.select(y.alias("y"), p.alias("p"))
    return d.agg(
        F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 2).alias("mae"),
        F.round(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)), 2).alias("rmse"),
        F.round(F.lit(1.0) - F.sum((F.col("y") - F.col("p")) ** 2)
                / (F.var_pop("y") * F.count("y")), 4).alias("r2"))


def classification_metrics(pred: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1 (4 dp) from the confusion counts.

    The confusion table has at most classes² rows; per-class precision and
    recall come from it with two small grouped aggregates.
    """
    conf = (pred.groupBy(F.col(label).cast("double").alias("y"),
                         F.col(prediction).cast("double").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    tp = conf.where(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    support = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per_class = (support.join(predicted, "c", "full").join(tp, "c", "left")
                 .na.fill(0, ["support", "predicted", "tp"])
                 .withColumn("prec", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted"))
                             .otherwise(0.0))
                 .withColumn("rec", F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
                             .otherwise(0.0))
                 .withColumn("f1", F.when(F.col("prec") + F.col("rec") > 0,
                                          2 * F.col("prec") * F.col("rec")
                                          / (F.col("prec") + F.col("rec"))).otherwise(0.0)))
    return per_class.agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("f1"))


# ------------------------------------------------------------------ models
def median_label(df: DataFrame, col: str = "prix"):
    """``label = prix > median(prix)`` (0/1) and the median itself."""
    med = quantiles(df, col, [0.5])[0]
    return df.withColumn("label", (F.col(col) > F.lit(med)).cast("int")), med


def together(spark, *fits) -> list:
    """Results of independent fits, run at the same time: boosting is a long
    chain of short jobs, and a cluster has room for several chains."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit))
                                    for fit in fits]]


def _fitted(kind, train, cols, target, params, prepared):
    """A booster of MLlib's, fitted over cells or, where that can't be done, by MLlib."""
    checkpoint_dir(train.sparkSession)
    estimator = kind(featuresCol="features", labelCol=target, **{**TRAINING_RUNTIME, **params})
    return first_order.fit(estimator, prepared) or estimator.fit(_assembled(train, cols))


def _gbt_regression(train, test, cols, target, params, use_log, prepared=None):
    own = prepared or first_order.prepare(train, cols, [target])
    model = _fitted(GBTRegressor, train, cols, target, params, own)
    if own and not prepared:
        own.done()
    pred = model.transform(_assembled(test, cols))
    return model, regression_metrics(pred, target, "prediction", use_log).first().asDict()


def train_regressions(df: DataFrame, raw_params=None, log_params=None) -> dict:
    """Boosted regressions on the raw and on the log price (metrics
    after ``expm1``) over the same split; the champion is the higher R²
    (a tie goes to the log model)."""
    cols = feature_columns(df)
    train, test = split(df)
    train = train.persist()
    own = first_order.prepare(train, cols, ["prix", "prix_log"])
    (raw_model, raw_m), (log_model, log_m) = together(
        df.sparkSession,
        lambda: _gbt_regression(train, test, cols, "prix", raw_params or REGRESSION_RAW, False, own),
        lambda: _gbt_regression(train, test, cols, "prix_log", log_params or REGRESSION_LOG, True, own))
    if own:
        own.done()
    train.unpersist()
    if raw_m["r2"] > log_m["r2"]:
        best, method, best_m = raw_model, "prix_brut", raw_m
    else:
        best, method, best_m = log_model, "log_prix", log_m
    return {"feature_columns": cols,
            "regression_raw": {"model": raw_model, **raw_m},
            "regression_log": {"model": log_model, **log_m},
            "champion": {"model": best, "method": method, **best_m}}


def train_classifier(df: DataFrame, params=None) -> dict:
    """Boosted classifier of ``prix > median(prix)`` on the same split."""
    cols = feature_columns(df)
    labelled, med = median_label(df)
    ltrain, ltest = split(labelled)
    own = first_order.prepare(ltrain, cols, ["label"])
    clf = _fitted(GBTClassifier, ltrain, cols, "label", params or CLASSIFIER, own)
    if own:
        own.done()
    clf_m = classification_metrics(clf.transform(_assembled(ltest, cols))).first().asDict()
    return {"feature_columns": cols, "classification": {"model": clf, "median": med, **clf_m}}


def enough_rows(df: DataFrame, min_rows: int = 10) -> bool:
    """The target exists and there are more than ``min_rows`` rows."""
    return "prix" in df.columns and df.limit(min_rows + 1).count() > min_rows


def train_models(df: DataFrame, raw_params=None, log_params=None, clf_params=None,
                 min_rows: int = 10) -> dict:
    """Raw and log regressions, champion by R², median classifier.

    Returns a dict with the fitted models, their metrics, the champion
    (``method`` is ``prix_brut`` or ``log_prix``) and the feature column
    order; empty when the guard (M13) fails.
    """
    if not enough_rows(df, min_rows):
        return {}
    checkpoint_dir(df.sparkSession)
    regressions, classifier = together(df.sparkSession,
                                       lambda: train_regressions(df, raw_params, log_params),
                                       lambda: train_classifier(df, clf_params))
    return {**regressions, **classifier}


def results_frame(spark, results: dict) -> DataFrame:
    """One row per trained model: name, mae, rmse, r2, accuracy, f1, method."""
    rows = []
    for name in ("regression_raw", "regression_log", "champion", "classification"):
        r = results.get(name, {})
        rows.append((name, r.get("mae"), r.get("rmse"), r.get("r2"), r.get("accuracy"),
                     r.get("f1"), results.get("champion", {}).get("method")
                     if name == "champion" else None))
    return spark.createDataFrame(
        rows, "model string, mae double, rmse double, r2 double, accuracy double, "
              "f1 double, method string")


def feature_importance(spark, model, cols: list[str], min_pct: float = 0.5) -> DataFrame:
    """Share of total importance in % (1 dp), above ``min_pct``, labelled,
    sorted descending (J10, L4, C17).  One row per feature (bounded)."""
    imp = model.featureImportances.toArray()
    weights = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)],
                                    "feature string, weight double")
    return importance_shares(weights, min_pct)


def importance_shares(weights: DataFrame, min_pct: float = 0.5) -> DataFrame:
    """J10, L4, C17 for any ``(feature, weight)`` table, one row per feature."""
    total = weights.agg(F.sum("weight")).first()[0] or 1.0
    share = F.col("weight") / F.lit(float(total)) * 100.0
    label = F.col("feature")
    for name, text in FEATURE_LABELS.items():
        label = F.when(F.col("feature") == name, F.lit(text)).otherwise(label)
    return (weights.where(share > min_pct)
            .select("feature", label.alias("name"), F.round(share, 1).alias("pct"))
            .orderBy(F.desc("pct"), "feature"))


def hyperparameters(spark, model) -> DataFrame:
    """The five boosting settings of a fitted model, one row."""
    get = model.getOrDefault
    return spark.createDataFrame(
        [(int(get("maxIter")), float(get("stepSize")), int(get("maxDepth")),
          float(get("subsamplingRate")), str(get("featureSubsetStrategy")))],
        "n_estimators int, learning_rate double, max_depth int, subsample double, "
        "colsample string")
