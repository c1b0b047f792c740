"""Market panels: histogram edges (Q6), room buckets (Q12), tie-breaks (L2)."""

from immolens.operators import market

MARKET = ("id_annonce long, prix double, surface double, pieces double, "
          "type_bien_APPARTEMENT boolean, type_bien_MAISON boolean, type_bien_TERRAIN boolean, "
          "type_bien_AUTRE boolean, type_bien_PARKING boolean, region string, city string")


def _m(spark, rows):
    return spark.createDataFrame(rows, MARKET)


def _row(i, prix, surface=50.0, pieces=3.0, t="A", region="R", city="C"):
    flags = [t == "A", t == "M", t == "T", t == "X", t == "P"]
    return (i, prix, surface, pieces, *flags, region, city)


def test_histogram_edges(spark):
    df = _m(spark, [_row(1, 0.0), _row(2, 50000.0), _row(3, 400000.0)])
    legacy = {r.bracket: r["count"] for r in market.price_histogram(df, legacy_edge=True).collect()}
    default = {r.bracket: r["count"] for r in market.price_histogram(df).collect()}
    assert legacy == {"0-50k€": 1, "50-100k€": 1}
    assert default == {"0-50k€": 1, "50-100k€": 1, "400-450k€": 1}


def test_room_buckets_skip_fractional(spark):
    df = _m(spark, [_row(1, 1.0, pieces=2.5), _row(2, 1.0, pieces=4.5), _row(3, 1.0, pieces=4.0)])
    assert market.filter_analysis(df, rooms="3-4 pièces").count() == 1
    assert market.filter_analysis(df, rooms="1-2 pièces").count() == 0


def test_filters(spark):
    df = _m(spark, [_row(1, 10.0, t="M", region="EU"), _row(2, 20.0, t="A", region="EU"),
                    _row(3, 30.0, t="M", region="AS")])
    assert market.filter_by_type(df, "Maison").count() == 2
    assert market.filter_by_type(df, "Tous").count() == 3
    assert market.filter_by_type(df, "Inconnu").count() == 3
    assert market.filter_by_region(market.filter_by_type(df, "Maison"), "EU").count() == 1
    assert market.filter_analysis(df, smin="abc", smax=" ").count() == 3


def test_top_k_ties_alphabetical(spark):
    raw = spark.createDataFrame([(c, 1.0, "00001", i) for i, c in
                                 enumerate(["b", "a", "b", "a", "c"])],
                                "city string, price double, zipcode string, ordinal long")
    top = [r.city for r in market.city_frequency(raw, 2).collect()]
    assert top == ["a", "b"]
    labels = {r.city: r.label for r in market.city_labels(raw, 3).collect()}
    assert labels["a"] == "a, 00001"


def test_type_cards_keep_empty(spark):
    df = _m(spark, [_row(1, 10.0, t="M"), _row(2, 30.0, t="M")])
    cards = {r.type: (r["count"], r.median_price) for r in market.type_cards(df).collect()}
    assert cards == {"Appartement": (0, None), "Maison": (2, 20)}


def test_quartiles_need_more_than_ten_rows(spark):
    assert market.analysis_quartiles(_m(spark, [_row(i, float(i)) for i in range(10)])).count() == 0
    q = market.analysis_quartiles(_m(spark, [_row(i, float(i * 1000)) for i in range(11)]))
    assert [r.bracket for r in q.collect()][0] == "< 2 500€"


def test_panel_medians_match_percentile(spark):
    from pyspark.sql import functions as F
    rows = [_row(i, float(1000 + (i * 7919) % 5000), surface=40.0 + i % 7,
                 t="AMTXP"[i % 5]) for i in range(200)]
    df = _m(spark, rows)
    for row in market.analysis_type_stats(df).collect():
        own = df.where(F.col(market.TYPE_COL_MAP[row.type])).agg(
            F.median("prix").alias("p"), F.median(F.col("prix") / F.col("surface")).alias("m2")).first()
        assert (row.median, row.prix_m2) == (int(own.p), int(own.m2))
    kpis, own = market.dashboard_kpis(df).first(), df.agg(F.median("prix")).first()[0]
    assert kpis.median_price == int(own)
    cards = {r.type: r.median_price for r in market.type_cards(df).collect()}
    assert set(cards) == set(market.CARD_TYPES) and all(v is not None for v in cards.values())


def test_confidence_needs_a_trained_model(spark):
    df = _m(spark, [_row(i, 1000.0, t="A") for i in range(3)])
    assert market.active_markets(df).first().confidence is None
    assert market.active_markets(df, 0.9).first().confidence == 90


def test_panels_and_report(spark):
    df = _m(spark, [_row(i, 100000.0 + i * 1000, t="AM"[i % 2]) for i in range(20)])
    parts = market.dashboard(df, "Maison", metrics={"mae": 55657.12, "rmse": 90235.81,
                                                    "r2": 0.7815, "method": "prix_brut"})
    assert set(parts) == {"kpis", "active_markets", "type_cards", "price_histogram", "model"}
    m = parts["model"].first()
    assert (m.mae, m.rmse, m.r2, m.r2_pct) == ("55 657", "90 236", "0.7815", "78.1")
    assert parts["kpis"].first().ads_count == 10
    raw = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rep = market.run_report(raw, raw.limit(2), {})
    c = rep["counts"].first()
    assert (c.raw_count, c.clean_count, c.dropped, c.train, c.test) == (3, 2, 1, 1, 0)
    assert rep["metrics"].first().mae is None


def test_city_map_with_town_table(spark):
    rows = []
    for i in range(20):
        rows.append(("Paris", 500000.0, 50.0, i))
    for i in range(4):
        rows.append(("Lyon", 200000.0, 100.0, 100 + i))
    rows.append(("Nowhere", 1.0, 1.0, 200))
    raw = spark.createDataFrame(rows, "city string, price double, surface double, ordinal long")
    out = {r.city: r for r in market.city_map(raw).collect()}
    assert set(out) == {"Paris", "Lyon"}
    assert out["Paris"].id == 1 and out["Paris"].price_m2 == 10000 and out["Paris"].active
    assert out["Lyon"].price_m2 == 2000 and not out["Lyon"].active
    assert out["Paris"].price == "10 000" and out["Lyon"].trend == "4 annonces"
    assert out["Paris"].lat == 48.8566


def test_scoring_options_are_made_without_python_rows(spark):
    """Fixed rows are literals of the plan, not rows that Python tasks hand over."""
    raw = spark.range(4).selectExpr("id AS ordinal", "'Lyon' AS city", "'69000' AS zipcode")
    ranges = spark.range(1).selectExpr("5L AS surface_min", "500L AS surface_max", "1L AS pieces_min",
                                       "9L AS pieces_max")
    out = market.scoring_options(raw, raw, ranges=ranges)
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted(tuple(r) for r in out.collect())
    assert rows[0] == ("cities", 1, "Lyon, 69000")
    assert [r[2] for r in rows if r[0] == "types"] == market.PROPERTY_TYPES[1:]
    assert [r[2] for r in rows if r[0] == "ranges"] == [
        "surface_min=5", "surface_max=500", "pieces_min=1", "pieces_max=9"]
