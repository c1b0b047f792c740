"""Quality step (C4-C7, P4, P5, F1, M1) on the reference fixtures."""

from immolens.operators import quality

SCHEMA = "id int, title string, type string, price int, city string, surface double, pieces double"
ROWS = [
    (1, "Appartement 4 pièces 90 m²", "Appartement", 130000, "Aubenas", None, None),
    (2, "Maison rénovée avec jardin", "Autre", 400000, "Mérignies", 150.0, None),
    (3, "T3 au centre ville", "Autre", 200000, "Lyon", None, None),
    (4, "Vente place de parking", "Autre", 15000, "Paris", None, None),
    (5, "Terrain constructible 500m2", "Terrain", 50000, "Nice", None, None),
]


def _by_id(df):
    return {r.id: r for r in df.collect()}


def test_surface_from_title(spark):
    out = _by_id(quality.extract_m2(spark.createDataFrame(ROWS, SCHEMA)))
    assert out[1].surface == 90.0 and out[5].surface == 500.0 and out[2].surface == 150.0


def test_rooms_from_title(spark):
    out = _by_id(quality.extract_m2(spark.createDataFrame(ROWS, SCHEMA)))
    assert out[1].pieces == 4.0 and out[3].pieces == 3.0


def test_type_from_title(spark):
    out = _by_id(quality.extract_m2(spark.createDataFrame(ROWS, SCHEMA)))
    assert out[2].type == "Maison" and out[4].type == "Parking" and out[1].type == "Appartement"


def test_type_last_keyword_wins_and_null_title(spark):
    df = spark.createDataFrame([(1, "Maison avec parking", "Autre"), (2, None, "Autre"),
                                (3, "Lot3 T2", None)], "id int, title string, type string")
    out = _by_id(quality.extract_m2(df))
    assert out[1].type == "Parking" and out[2].type == "Autre"
    assert out[3].pieces == 3.0


def test_constraints(spark):
    df = spark.createDataFrame([("Maison", 0, "Paris", 100.0, 0.0),
                                ("Appartement", 200000, "Lyon", 50.0, 4000.0)],
                               "type string, price int, city string, surface double, price_m2 double")
    out = quality.validate_constraints(df).collect()
    assert len(out) == 1 and out[0].city == "Lyon"


def test_full_quality_step(spark):
    out = quality.data_quality(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(r.id for r in out.collect()) == [1, 2, 5]
    assert "price_m2" in out.columns


def test_missing_columns_created(spark):
    df = spark.createDataFrame([(1, 100.0)], "id int, price double")
    out = quality.extract_m2(df)
    assert {"surface", "pieces", "price_m2"} <= set(out.columns)


def test_rule_counts_and_rejected_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    counts = quality.rule_counts(df).first()
    assert counts.rows_in == 5 and counts.rows_out == 3
    rejected = {r.id: r.failed_rule for r in quality.rejected_rows(df, ("id",)).collect()}
    assert set(rejected) == {3, 4} and rejected[3] == "surface"
