"""Feature operators (F2, P7, A2, M4, M3, M5, M6, M7) on the reference fixtures."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from immolens.operators import features, models

SCHEMA = ("prix int, surface double, pieces double, ville string, type_bien string, "
          "title string")
ROWS = [
    (100000, 50.0, 2.0, "PARIS", "APPARTEMENT", "Bel appartement rénové"),
    (200000, 60.0, 3.0, "LYON", "MAISON", "Maison avec jardin"),
    (300000, 70.0, 3.0, "PARIS", "APPARTEMENT", "Studio calme"),
    (400000, 80.0, 4.0, "LYON", "MAISON", "Maison à rénover"),
    (500000, 90.0, 5.0, "BORDEAUX", "APPARTEMENT", "Appartement neuf"),
]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_outlier_bounds(spark):
    d = spark.range(100).select(F.col("id").cast("int").alias("prix"))
    out = features.remove_outliers(d, "prix", 0.1, 0.9).agg(F.min("prix"), F.max("prix")).first()
    assert tuple(out) == (10, 89)


def test_log_features(df):
    out = features.add_derived_features(df)
    assert isinstance(out.schema["prix_log"].dataType, NumericType)
    assert out.first().prix_log == pytest.approx(11.512935464920228)


def test_target_encoding_values(df):
    enc = {r.ville: r.encoding for r in features.fit_target_encoding(df).collect()}
    assert enc["PARIS"] == pytest.approx(290909.0909, abs=1e-3)
    assert enc["LYON"] == pytest.approx(300000.0)
    assert enc["BORDEAUX"] == pytest.approx(309523.8095, abs=1e-3)
    encoded, _ = features.target_encode_ville(df)
    assert isinstance(encoded.schema["ville"].dataType, NumericType)


def test_apply_saved_encoding_equals_fit(df, spark):
    fitted, enc = features.target_encode_ville(df)
    new = spark.createDataFrame([(" paris ",), ("Lyon",)], "ville string")
    applied = features.apply_target_encoding(new, enc, "ville", normalise=True)
    got = [r.ville for r in applied.collect()]
    expected = {r.ville for r in fitted.collect()}
    assert set(got) <= expected and None not in got


def test_unknown_city(df, spark):
    _, enc = features.target_encode_ville(df)
    new = spark.createDataFrame([("NICE",)], "ville string")
    with pytest.raises(KeyError):
        features.apply_target_encoding(new, enc, "ville", on_unknown="error")
    mean = enc.agg(F.avg("encoding")).first()[0]
    out = features.apply_target_encoding(new, enc, "ville", on_unknown="default").first()
    assert out.ville == pytest.approx(mean)


def test_one_hot(df):
    out = features.encode_categoricals(df.drop("title"))
    assert "type_bien_APPARTEMENT" in out.columns and "type_bien_MAISON" in out.columns
    assert "type_bien" not in out.columns


def test_clusters(df):
    d = features.encode_categoricals(features.add_derived_features(df.drop("title")))
    out, model = models.train_clustering(d, 2, ["surface", "pieces"], seed=1)
    assert "cluster" in out.columns and out.count() == 5
    again = models.predict_cluster(d, model)
    assert [r.cluster for r in again.collect()] == [r.cluster for r in out.collect()]


def test_engineer_features_all_numeric(df):
    out, enc, model = features.engineer_features(df, n_cluster=2)
    for f in out.schema.fields:
        assert isinstance(f.dataType, (NumericType, BooleanType)), f
    assert out.count() == 3
    assert sorted(r.prix for r in out.collect()) == [200000, 300000, 400000]


def test_saved_cluster_model_and_encoding_roundtrip(spark, df, tmpdir_path):
    import os
    from immolens.sources import snapshots
    d = features.encode_categoricals(features.add_derived_features(df.drop("title")))
    out, model = models.train_clustering(d, 2, ["surface", "pieces"], seed=3)
    snapshots.save_model(model, os.path.join(tmpdir_path, "kmeans"))
    again = models.predict_cluster(d, snapshots.load_pipeline_model(os.path.join(tmpdir_path, "kmeans")))
    assert [r.cluster for r in again.collect()] == [r.cluster for r in out.collect()]
    _, enc = features.target_encode_ville(df)
    snapshots.save_encoding(enc, os.path.join(tmpdir_path, "enc"))
    loaded = snapshots.load_encoding(spark, os.path.join(tmpdir_path, "enc"))
    assert sorted(loaded.collect()) == sorted(enc.collect())
