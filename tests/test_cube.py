"""The panel cube against the panels computed from the rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from immolens.operators import market
from immolens.operators.cube import DIMENSIONS, PanelCube, slices_of, totals_of, wide_slice

MARKET = ("id_annonce long, prix double, surface double, pieces double, "
          "type_bien_APPARTEMENT boolean, type_bien_MAISON boolean, type_bien_TERRAIN boolean, "
          "type_bien_AUTRE boolean, type_bien_PARKING boolean, region string, city string")


def some_rows(n, seed=5):
    r = random.Random(seed)
    for i in range(n):
        t = r.choice("AAMTX-")
        yield (i, r.choice([None, 100.0, 1e5 * r.random(), r.uniform(-5, 5), 2e6 * r.random()]),
               r.choice([None, 0.0, 40.0, 200 * r.random()]), r.choice([None, 2.0, 2.5, 3.0, 7.0]),
               t == "A", t == "M", t == "T", t == "X", False,
               r.choice([None, "EU", "AS", "France entière", ""]),
               r.choice([None, "Lyon", "Paris", "Toutes villes"]))


def build(spark, tmp, rows, schema=MARKET):
    df = spark.createDataFrame(rows, schema)

    def store(name, make):
        path = f"{tmp}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        return spark.read.parquet(path)
    return PanelCube.build(df, store)


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    return build(spark, str(tmp_path_factory.mktemp("cube")), list(some_rows(600)))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and dict(a.dtypes) == dict(b.dtypes)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("type_str", ["Tous", "Maison", "Parking", "Inconnu", None])
@pytest.mark.parametrize("region", ["France entière", "EU", "nowhere"])
def test_dashboard(cube, type_str, region):
    rows = market.panel_filter(cube.rows, type_str, region)
    same(cube.dashboard_kpis(type_str, region), market.dashboard_kpis(rows))
    same(cube.active_markets(type_str, region, 0.8), market.active_markets(rows, 0.8))
    same(cube.type_cards(type_str, region), market.type_cards(rows))
    same(cube.price_histogram(type_str, region), market.price_histogram(rows))
    same(cube.price_histogram(type_str, region, True), market.price_histogram(rows, legacy_edge=True))


@pytest.mark.parametrize("zone,type_str,rooms", [
    ("Toutes villes", "Tous", "Toutes pièces"), ("Lyon", "Tous", "1-2 pièces"),
    ("Paris", "Appartement", None), (None, "Terrain", "7+ pièces"), ("Oslo", None, "5-6 pièces")])
def test_analysis(cube, zone, type_str, rooms):
    own = market.panel_filter(cube.rows, type_str, zone=zone, rooms=rooms)
    same(cube.analysis_stats(zone, type_str, rooms), market.analysis_stats(own))
    same(cube.analysis_quartiles(zone, type_str, rooms), market.analysis_quartiles(own))
    same(cube.analysis_type_stats(zone, type_str, rooms), market.analysis_type_stats(own))


def test_surface_bounds_come_from_the_rows(spark, cube):
    raw = spark.createDataFrame([("Lyon", 1.0, 2.0, "Maison")] * 3,
                                "city string, price double, surface double, type string")
    for smin, smax in (("30", "100"), ("x", None)):
        own = market.analysis(cube.rows, raw, smin=smin, smax=smax, rooms="1-2 pièces")
        for name, part in cube.analysis(raw, smin=smin, smax=smax, rooms="1-2 pièces").items():
            same(part, own[name])
    assert set(cube.dashboard()) == set(market.dashboard(cube.rows))


def test_input_ranges(cube, spark, tmpdir_path):
    same(cube.input_ranges(), market.input_ranges(cube.rows))


def test_a_panel_is_two_jobs(spark, cube):
    """One scan of each table, whatever the number of types and measures."""
    for make in (cube.dashboard_kpis, cube.active_markets, cube.type_cards, cube.analysis_stats,
                 cube.analysis_quartiles, cube.analysis_type_stats, cube.input_ranges):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "panel")
        make().collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setJobGroup("", "")
        assert 1 <= len(jobs) <= 2, (make.__name__, len(jobs))


def test_no_rows_and_missing_columns(spark, tmpdir_path):
    empty = build(spark, tmpdir_path, [])
    assert empty.dashboard_kpis().first().ads_count == 0
    same(empty.dashboard_kpis(), market.dashboard_kpis(empty.rows))
    same(empty.type_cards(), market.type_cards(empty.rows))
    same(empty.analysis_stats(), market.analysis_stats(empty.rows))
    assert empty.price_histogram().collect() == [] and empty.active_markets().collect() == []
    assert empty.analysis_quartiles().collect() == []
    same(empty.input_ranges(), market.input_ranges(empty.rows))
    few = build(spark, tmpdir_path, [(1.0 * i, 10.0, i % 2 == 0) for i in range(30)],
                "prix double, surface double, type_bien_MAISON boolean")
    own = market.panel_filter(few.rows, "Maison", "EU")
    same(few.dashboard_kpis("Maison", "EU"), market.dashboard_kpis(own))
    same(few.type_cards("Appartement"), market.type_cards(market.panel_filter(few.rows, "Appartement")))
    same(few.analysis_stats("Lyon", "Maison", "3-4 pièces"), market.analysis_stats(own))


def test_running_counts(cube):
    """Each cell's values are numbered without a gap, and each row is counted once."""
    v = cube.values
    cells = ["type", "region", "city", "rooms", "measure"]
    bad = (v.groupBy(*cells).agg(F.sum("n").alias("n"), F.max("total").alias("t"),
                                 F.sort_array(F.collect_list(F.struct("value", "before", "n"))).alias("x"))
           .where("n <> t OR exists(sequence(1, size(x) - 1), i -> i < size(x) AND "
                  "get(x, i).before <> get(x, i-1).before + get(x, i-1).n) OR x[0].before <> 0"))
    assert v.count() > 500
    assert bad.where("size(x) > 1").count() == 0


def test_values_of_wanted_slices_are_ranked_on_the_cluster(spark, tmpdir_path, monkeypatch):
    """The same quantiles where the driver ranks no row itself, hot and odd values included."""
    rows = [*some_rows(300, 8), *((i, p, 7.0, 2.0, True, False, False, False, False, "EU", "Lyon")
                                  for i in range(40) for p in (2e5, 2e5 + i / 8, -0.0, float("nan")))]
    cube = build(spark, tmpdir_path, rows)
    monkeypatch.setattr("immolens.operators.cube.FEW", 0)
    cell = cube.cell()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = cube.quantiles([(cell, m) for m in ("prix", "surface", "pieces")], probs)
    for m in ("prix", "surface", "pieces"):
        assert str(got[cell, m]) == str(market.quantiles(cube.rows, m, probs))
    same(cube.analysis_type_stats("Lyon"), market.analysis_type_stats(market.panel_filter(cube.rows, zone="Lyon")))


def test_stored_rows_have_a_bound(spark, tmpdir_path):
    """Ten times the listings in the same cells do not add as many rows to the cube."""
    def stored(n):
        rows = spark.range(n).selectExpr(
            "id AS id_annonce", f"100000 + 150000 * id / {n} AS prix", "50D AS surface", "3D AS pieces",
            "true AS type_bien_MAISON", "'EU' AS region", "'Lyon' AS city")
        cube = PanelCube.build(rows, lambda _, make: make().localCheckpoint())
        return cube.totals.count() + cube.slices.count()
    assert stored(20_000) < 1.5 * stored(2_000) < 20_000


def test_wide_slices_rise_with_the_values(spark):
    r = random.Random(3)
    odd = [0.0, -0.0, 5e-324, 1e-310, 2.0 ** -1022, 1.0, 2.0 ** 52, 1.7976931348623157e308,
           float("inf"), *(2.0 ** k * (1 + e) for k in (-3, 0, 17) for e in (-2.0 ** -53, 0, 2.0 ** -52)),
           *(10 ** r.uniform(-300, 300) for _ in range(300)), *(r.uniform(1, 500_000) for _ in range(300))]
    rows = spark.createDataFrame([(x,) for v in odd for x in (v, -v)] + [(float("nan"),)], "v double")
    got = [tuple(x) for x in rows.select("v", wide_slice(F.col("v"))).collect()]
    slices = [s for _, s in sorted((x for x in got if x[0] == x[0]))]
    assert slices == sorted(slices) and [s for v, s in got if v != v][0] > slices[-1]
    octave = spark.range(1024).select(wide_slice(1 + F.col("id") / 1024).alias("s"))
    assert octave.distinct().count() == 32


def test_listings_are_counted_without_interpreted_functions(spark, cube):
    """Functions on arrays before the generator are evaluated row by row without
    generated code, and once more in the filter that Catalyst infers from them."""
    plan = slices_of(cube.rows)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode(array(struct("):]
    assert "lambda" not in below and "size(" not in below


def test_cells_are_formed_of_counts_alone(spark):
    """No row forms its cells, or a filter on them, before it is counted."""
    made = spark.createDataFrame(
        [(1.0, 2.0, 3.0, True, "R", "C"), (2.0, 2.0, None, False, None, "C"), (3.0, 1.0, 1.0, True, "R", None)],
        "prix double, surface double, pieces double, type_bien_MAISON boolean, region string, city string")
    for table in (totals_of(made), slices_of(made)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in plan and "transform(" not in plan
    found = {tuple(r[d] for d in DIMENSIONS): r["n"] for r in totals_of(made).collect()}
    names = [r[0] for r in made.orderBy("prix").select(market.room_bucket("pieces")).collect()]
    assert found[None, None, None, None] == 3 and found["Maison", None, None, None] == 2
    assert found[None, "R", None, None] == 2 and found["Maison", "R", None, None] == 2
    assert found[None, None, "C", None] == 2 and found["Maison", None, "C", names[0]] == 1
    assert found[None, None, None, names[2]] == 1 and (None, "R", "C", None) not in found
