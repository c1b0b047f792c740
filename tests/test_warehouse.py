"""Star schema (M19, W4, J1-J3, C8, C9, F13) and marts (A3-A5)."""

import datetime as dt

from immolens.operators import marts, warehouse
from immolens.operators.keys import sequence_ids

COLS = ("id long, title string, type string, price double, surface double, price_m2 double, "
        "city string, zipcode string, region string, author string, url string, "
        "image_url string, created_at timestamp, ordinal long")


def _rows():
    t1, t2 = dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 7)
    return [
        (1, "a", "Maison", 100.0, 10.0, 10.0, "Lyon", "7200", None, "A", "u", "i", t1, 0),
        (2, "b", "Terrain", 300.0, 30.0, 10.0, "Lyon", "7200", None, "B", "u", "i", t2, 1),
        (3, "c", "Maison", 200.0, None, None, "Nice", "ABCDEF7", "PACA", "A", "u", "i", t1, 2),
        (1, "a", "Maison", 999.0, 10.0, 99.9, "Lyon", "7200", None, "A", "u", "i", t1, 3),
        (4, "d", "Maison", 50.0, 5.0, 10.0, "Nice", None, "PACA", "C", "u", "i", t2, 4),
    ]


def test_star(spark):
    star = warehouse.build_star(spark.createDataFrame(_rows(), COLS))
    types = {r.type_name: r.id_type for r in star["dim_type"].collect()}
    assert types == {"Maison": 1, "Terrain": 2}
    locs = {(r.city, r.zipcode): r.id_location for r in star["dim_location"].collect()}
    assert locs == {("Lyon", "07200"): 1, ("Nice", "ABCDEF7"): 2, ("Nice", None): 3}
    dates = {r.id_date: (r.year, r.month, r.day) for r in star["dim_date"].collect()}
    assert dates == {1: (2024, 1, 5), 2: (2024, 2, 7)}
    fact = {r.id_annonce: r for r in star["fact_ads"].collect()}
    assert sorted(fact) == [1, 2, 3, 4]
    assert fact[1].price == 100.0            # the first listing of id 1 wins
    assert fact[1].id_location == 1          # null region still joins (J2)
    assert fact[4].id_location == 3          # null zipcode still joins
    audit = {r.rule: r.violations for r in warehouse.integrity_audit(star).collect()}
    assert all(v == 0 for v in audit.values()), audit


def test_city_mart(spark):
    star = warehouse.build_star(spark.createDataFrame(_rows(), COLS))
    rows = {r.city: r for r in marts.city_mart(star).collect()}
    assert rows["Lyon"].volume_annonces == 2 and rows["Lyon"].prix_moyen == 200.0
    assert rows["Lyon"].prix_minimum == 100.0 and rows["Lyon"].prix_maximum == 300.0
    monthly = {(r.year, r.month): r.volume_annonces for r in marts.monthly_mart(star).collect()}
    assert monthly == {(2024, 1): 2, (2024, 2): 2}


def test_sequence_ids_dense_across_slices(spark):
    df = spark.createDataFrame([(v,) for v in (5, 3_000_000, 7, 1 << 21, 10)], "o long")
    out = {r.o: r.n for r in sequence_ids(df, "o", "n", slice_width=1 << 20).collect()}
    assert out == {5: 1, 7: 2, 10: 3, 1 << 21: 4, 3_000_000: 5}


def test_warehouse_job_append_is_idempotent(spark, tmpdir_path):
    from immolens.plans import jobs
    raw = spark.createDataFrame(_rows(), COLS)
    jobs.build_warehouse(spark, raw, tmpdir_path)
    first = {n: t.count() for n, t in jobs.build_warehouse(spark, raw, tmpdir_path).items()}
    again = {n: t.count() for n, t in
             jobs.build_warehouse(spark, raw, tmpdir_path, mode="append").items()}
    assert first == again
    more = raw.unionByName(spark.createDataFrame(
        [(9, "z", "Parking", 10.0, 1.0, 10.0, "Brest", "29200", "BZH", "Z", "u", "i",
          dt.datetime(2024, 3, 1), 9)], COLS))
    tables = jobs.build_warehouse(spark, more, tmpdir_path, mode="append")
    ids = {r.type_name: r.id_type for r in tables["dim_type"].collect()}
    assert ids == {"Maison": 1, "Terrain": 2, "Parking": 3}
    assert tables["fact_ads"].count() == first["fact_ads"] + 1
    assert jobs.preview(spark).count() <= 5
    audit = {r.rule: r.violations for r in warehouse.integrity_audit(tables).collect()}
    assert all(v == 0 for v in audit.values()), audit


def test_star_invariant_to_input_partitioning(spark):
    import os
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    from immolens.sources.adapter import listings
    raw = listings(spark, sf)
    base = warehouse.build_star(raw)
    shuffled = warehouse.build_star(raw.repartition(7).sortWithinPartitions("price"))
    for name in ("dim_location", "dim_date", "fact_ads"):
        assert sorted(base[name].collect()) == sorted(shuffled[name].collect()), name
    assert sorted(marts.city_mart(base).collect()) == sorted(marts.city_mart(shuffled).collect())


def test_sql_views_equal_dataframe_marts(spark):
    from immolens.plans import views
    star = warehouse.build_star(spark.createDataFrame(_rows(), COLS))
    for name, df in star.items():
        df.createOrReplaceTempView(name)
    views.create_mart_views(spark)
    pairs = {"dm_stats_par_ville": marts.city_mart, "dm_stats_region_type": marts.region_type_mart,
             "dm_stats_mensuelles": marts.monthly_mart}
    for view, fn in pairs.items():
        assert spark.table(view).collect() == fn(star).collect(), view
