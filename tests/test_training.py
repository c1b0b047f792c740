"""Training (M8-M15, A20, A23, A24), batch scoring and projections."""

import os
import random

import pytest
from pyspark.sql import functions as F

from immolens.operators import bundle, models, scoring
from immolens.plans import jobs

SMALL = dict(maxIter=3, stepSize=0.1, maxDepth=3, seed=42)


@pytest.fixture()
def train_df(spark):
    rnd = random.Random(42)
    rows = []
    for i in range(100):
        prix = rnd.randrange(50000, 500000)
        rows.append((i, prix, rnd.uniform(20, 200), float(rnd.randrange(1, 10)),
                     rnd.uniform(100000, 500000), rnd.uniform(10, 15),
                     rnd.random() < 0.5, rnd.random() < 0.5, False, False, False))
    return spark.createDataFrame(rows, "id_annonce long, prix int, surface double, pieces double, "
                                       "ville double, prix_log double, "
                                       "type_bien_APPARTEMENT boolean, type_bien_MAISON boolean, "
                                       "type_bien_PARKING boolean, type_bien_TERRAIN boolean, "
                                       "type_bien_AUTRE boolean")


def test_train_and_save(spark, train_df, tmpdir_path):
    encoding = spark.createDataFrame([("PARIS", 300000.0)], "ville string, encoding double")
    jobs.snapshots.save_encoding(encoding, os.path.join(tmpdir_path, "models", "city_encoding"))
    res = jobs.train(spark, train_df, tmpdir_path, SMALL, SMALL, SMALL)
    for key in ("regression_raw", "regression_log", "champion", "classification"):
        assert key in res
    assert res["champion"]["method"] in ("prix_brut", "log_prix")
    assert 0.0 <= res["classification"]["accuracy"] <= 1.0
    stored = bundle.metrics(spark, jobs.bundle_folder(tmpdir_path))
    assert stored == {k: res["champion"][k] for k in ("mae", "rmse", "r2", "method")}
    imp = models.feature_importance(spark, res["champion"]["model"], res["feature_columns"])
    assert imp.count() >= 1
    hp = models.hyperparameters(spark, res["champion"]["model"]).first()
    assert hp.n_estimators == 3 and hp.max_depth == 3


def test_too_few_rows(spark, train_df):
    assert models.train_models(train_df.limit(10)) == {}


def test_split_is_stable(spark, train_df):
    a = sorted(r.id_annonce for r in models.split(train_df)[1].collect())
    b = sorted(r.id_annonce for r in models.split(train_df.repartition(7))[1].collect())
    assert a == b and 5 <= len(a) <= 40
    ids = spark.range(20_000).withColumnRenamed("id", "id_annonce")
    train, test = models.split(ids)
    assert 0.19 < test.count() / 20_000 < 0.21 and train.join(test, "id_annonce").count() == 0
    assert train.count() + test.count() == 20_000
    nulls = spark.createDataFrame([(None,), (None,)], "id_annonce long")
    assert sum(df.count() for df in models.split(nulls)) == 2


def test_metrics(spark):
    pred = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "label double, prediction double")
    m = models.regression_metrics(pred).first()
    assert m.mae == pytest.approx(0.67) and m.r2 == pytest.approx(0.75)
    cls = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "label int, prediction int")
    c = models.classification_metrics(cls).first()
    assert c.accuracy == 0.75 and c.f1 == pytest.approx(0.7333)


def test_projections(spark):
    df = spark.createDataFrame([(1, 100000.0)], "id long, prix double")
    out = {r.period: (r.price, r.pct) for r in scoring.projections(df, "prix", ["id"]).collect()}
    assert out == {"Auj.": (100000, None), "6 mois": (101750, "+1.8%"),
                   "1 an": (103499, "+3.5%"), "2 ans": (107122, "+7.1%")}


def test_batch_scoring(spark, train_df):
    feats, km = models.train_clustering(
        train_df.withColumn("surface_log", F.log1p("surface")), 2)
    res = models.train_models(feats, SMALL, SMALL, SMALL)
    enc = spark.createDataFrame([("PARIS", 300000.0), ("LYON", 200000.0)], "ville string, encoding double")
    req = spark.createDataFrame([("Paris, 75000", "Appartement", 50.0, 2),
                                 ("Brest", "Maison", 80.0, 0)],
                                "city string, property_type string, surface_area double, rooms int")
    out = scoring.score(req, enc, km, res["champion"]["model"], res["feature_columns"],
                        res["champion"]["method"], 0.78).collect()
    assert len(out) == 2 and all(r.current_estimated_price > 0 for r in out)
    assert out[0].confidence == 78.0


def test_prepare_job_audit(spark, tmpdir_path):
    from immolens.sources.adapter import listings
    raw = listings(spark, "/root/testdata/sf0.001")
    out = jobs.prepare(spark, raw, tmpdir_path, "2024-01-01", n_cluster=3)
    audit = {r.stage: (r.rows_in, r.rows_out) for r in out["audit"].collect()}
    assert audit["ingest"][1] == raw.count()
    assert audit["quality"][0] == audit["ingest"][1]
    assert audit["features"][1] == jobs.latest_features(spark, tmpdir_path).count()
    assert "cluster" in jobs.latest_features(spark, tmpdir_path).columns


def test_log_champion_is_inverted(spark, train_df):
    feats, km = models.train_clustering(train_df.withColumn("surface_log", F.log1p("surface")), 2)
    res = models.train_regressions(feats, SMALL, SMALL)
    enc = spark.createDataFrame([("PARIS", 300000.0)], "ville string, encoding double")
    req = spark.createDataFrame([("Paris", "Maison", 80.0, 3)],
                                "city string, property_type string, surface_area double, rooms int")
    log_model = res["regression_log"]["model"]
    raw_price = scoring.score(req, enc, km, log_model, res["feature_columns"], "prix_brut").first()
    inverted = scoring.score(req, enc, km, log_model, res["feature_columns"], "log_prix").first()
    assert raw_price.current_estimated_price < 20          # a log-scale number
    assert inverted.current_estimated_price > 10000         # back on the price scale
    clamped = scoring.score(req, enc, km, log_model, res["feature_columns"], "log_prix",
                            ranges={"surface_min": 100, "surface_max": 200,
                                    "pieces_min": 1, "pieces_max": 2}).first()
    assert clamped.surface_area == 100.0 and clamped.rooms == 2


@pytest.fixture(scope="module")
def coarse(spark):
    """Features of few values, so that MLlib's cuts are all of them too."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        a, b, c = rnd.randrange(12), rnd.randrange(5), rnd.random() < 0.1
        y = a * 3.0 + (b - 2) ** 2 * 5 + 20 * c + rnd.gauss(0, 2)
        rows.append((i, float(a), b, c, y, int(y > 25)))
    return spark.createDataFrame(rows, "id_annonce long, a double, b int, c boolean, prix double, label int")


@pytest.mark.parametrize("kind,label", [(models.GBTRegressor, "prix"), (models.GBTClassifier, "label")])
def test_trees_over_cells_are_those_of_mllib(coarse, kind, label):
    params = dict(maxIter=6, stepSize=0.1, maxDepth=4, seed=42)
    own = models.first_order.prepare(coarse, ["a", "b", "c"], [label])
    got = models._fitted(kind, coarse, ["a", "b", "c"], label, params, own)
    own.done()
    rows = models._assembled(coarse, ["a", "b", "c"])
    want = kind(featuresCol="features", labelCol=label, **params).fit(rows)
    assert got.getNumTrees == want.getNumTrees == 6 and list(got.treeWeights) == list(want.treeWeights)
    assert got.totalNumNodes == want.totalNumNodes and type(got) is type(want)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
    a, b = ([r.prediction for r in m.transform(rows).orderBy("id_annonce").collect()] for m in (got, want))
    assert a == pytest.approx(b, rel=1e-9)
    assert {p.name: v for p, v in got.extractParamMap().items()} == {
        **{p.name: v for p, v in want.extractParamMap().items()}, "checkpointInterval": 10}
    assert "impurity" not in str(got.toDebugString) and got.trees[1]._call_java("rootNode").impurity() == \
        pytest.approx(want.trees[1]._call_java("rootNode").impurity())


def test_drawn_trees_do_not_depend_on_partitions(coarse, monkeypatch):
    """Rows and features are drawn by hashes, over cells that several tasks share; the rows
    of a tree and the features of a node are as many as MLlib would draw."""
    monkeypatch.setattr(models.first_order.cells, "PART_ROWS", 100)
    params = dict(maxIter=4, stepSize=0.1, maxDepth=3, seed=42, subsamplingRate=0.8, featureSubsetStrategy="0.5")
    shown, drawn = [], []
    for rows in (coarse.coalesce(1), coarse.repartition(5)):
        own = models.first_order.prepare(rows, ["a", "b", "c"], ["prix"])
        model = models._fitted(models.GBTRegressor, rows, ["a", "b", "c"], "prix", params, own)
        own.done()
        shown.append(model.toDebugString.split("\n", 1)[1])
        drawn = [t._call_java("rootNode").impurityStats().count() for t in model.trees]
    assert shown[0] == shown[1] and len(set(drawn)) > 1 and all(420 < n < 540 for n in drawn)


def test_mllib_fits_what_cells_do_not(spark, coarse, monkeypatch):
    first_order = models.first_order
    assert first_order.prepare(coarse.limit(0), ["a"], ["prix"]) is None
    assert first_order.prepare(coarse.withColumn("prix", F.lit(None).cast("double")), ["a"], ["prix"]) is None
    own = first_order.prepare(coarse, ["a", "b"], ["prix"])
    few = dict(maxIter=2, maxDepth=2, seed=1)
    assert first_order.fit(models.GBTRegressor(labelCol="prix", minInfoGain=0.5, **few), own) is None
    own.done()
    monkeypatch.setattr(first_order.cells, "MOST_CELLS", 3)
    assert first_order.prepare(coarse, ["a", "b"], ["prix"]) is None
    model, found = models._gbt_regression(coarse, coarse, ["a", "b"], "prix", few, False)
    assert model.getNumTrees == 2 and found["r2"] > 0


def test_models_at_their_size_take_few_jobs(spark, coarse):
    """A fit of 200 trees starts fewer than 40 jobs; level by level it was about 1 600."""
    spark.sparkContext.setJobGroup("few", "few")
    try:
        model, _ = models._gbt_regression(coarse, coarse, ["a", "b", "c"], "prix", models.REGRESSION_RAW, False)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.getNumTrees == 200
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 40
