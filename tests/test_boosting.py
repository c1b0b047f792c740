"""Second-order boosting against plain numpy, MLlib, and itself on other layouts."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from immolens.operators import boosting, models
from immolens.operators.boosting import Boosted, Settings

NAMES = ["surface", "pieces", "ville", "flag"]


@pytest.fixture()
def store(spark, tmpdir_path):
    def put(name, make):
        path = f"{tmpdir_path}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        return spark.read.parquet(path)
    return put


@pytest.fixture(scope="module")
def homes(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        s, p, v, f = round(r.uniform(20, 200), 1), float(r.randint(1, 6)), r.choice([1e5, 2e5, 4e5]), r.random() < .3
        price = round(1500 * s + 8000 * p + v * (0.5 if f else 0.2) + r.gauss(0, 8000), 2)
        rows.append((i, s if i % 50 else None, p, v, f, price, float(np.log1p(price)), int(price > 3e5)))
    return spark.createDataFrame(rows, "id_annonce long, surface double, pieces double, ville double, "
                                       "flag boolean, prix double, prix_log double, label int")


def plain(df, settings, cuts):
    """Depth-first trees with sums over all rows of a node."""
    rows = sorted(df.collect(), key=lambda r: r.id_annonce)
    x = np.array([[sum(c < float(r[n]) for c in own) if r[n] is not None else 0
                   for n, own in zip(NAMES, cuts, strict=True)] for r in rows])
    y = np.array([float(r[settings.label]) for r in rows])
    margin = np.full(len(y), y.mean() if settings.loss == "squared" else np.log(y.mean() / (1 - y.mean())))
    for tree in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (margin - y, np.ones(len(y))) if settings.loss == "squared" else (p - y, p * (1 - p))
        step = np.zeros(len(y))

        def grow(at, depth):
            score = lambda i: g[i].sum() ** 2 / (h[i].sum() + settings.l2)
            best = (0.0, None)
            for f in range(len(NAMES)) if depth < settings.depth else ():
                for b in range(len(cuts[f])):
                    left, right = at[x[at, f] <= b], at[x[at, f] > b]
                    if len(left) and len(right):
                        gain = 0.5 * (score(left) + score(right) - score(at))
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1] is None:
                step[at] = -settings.rate * g[at].sum() / (h[at].sum() + settings.l2)
            else:
                for part in best[1]:
                    grow(part, depth + 1)
        grow(np.arange(len(y)), 0)
        margin = margin + step
    return margin


@pytest.mark.parametrize("loss,label", [("squared", "prix"), ("logistic", "label")])
def test_trees_are_those_of_plain_sums(homes, store, loss, label):
    own = Settings(label, loss, trees=3, depth=3, rate=0.3, rows=1.0, columns=1.0)
    model = boosting.fit(homes, NAMES, {"m": own}, "id_annonce", store, bins=8)["m"]
    got = [r.x for r in homes.withColumn("x", model.margin()).orderBy("id_annonce").collect()]
    assert np.allclose(got, plain(homes, own, model.cuts), rtol=1e-9)
    again = Boosted.from_json(model.to_json())
    assert [r.x for r in homes.withColumn("x", again.margin()).orderBy("id_annonce").collect()] == got


def test_trees_do_not_depend_on_partitions_or_company(homes, store):
    given = {"raw": Settings("prix", trees=3, depth=3), "log": Settings("prix_log", trees=2, depth=4)}
    one = boosting.fit(homes.coalesce(1), NAMES, given, "id_annonce", store)
    many = boosting.fit(homes.repartition(8), NAMES, given, "id_annonce", store)
    alone = boosting.fit(homes, NAMES, {"log": given["log"]}, "id_annonce", store)
    assert one["raw"].trees == many["raw"].trees and one["log"].trees == many["log"].trees
    assert alone["log"].trees == one["log"].trees
    assert len(one["raw"].trees) == 3 and len(one["log"].trees) == 2
    assert sum(one["raw"].gains) > 0 and one["raw"].importance(homes.sparkSession).count() == 4


def test_not_worse_than_first_order_boosting(homes, store, monkeypatch):
    monkeypatch.setattr(boosting, "CUT_EVERY", 3)
    train, test = models.split(homes.na.fill(0.0))
    params = dict(maxIter=10, stepSize=0.3, maxDepth=4, seed=42)
    mllib, first = models._gbt_regression(train, test, NAMES, "prix", params, False)
    own = boosting.fit(train, NAMES, {
        "raw": Settings("prix", trees=10, depth=4, rate=0.3, rows=1.0, columns=1.0),
        "clf": Settings("label", "logistic", trees=5, depth=3, rate=0.3)}, "id_annonce", store)
    second = models.regression_metrics(own["raw"].predict(test), "prix").first()
    assert second.r2 >= first["r2"] and second.r2 > 0.8
    assert models.classification_metrics(own["clf"].predict(test)).first().accuracy > 0.85


def test_no_rows_and_no_labels(spark, homes, store):
    none = boosting.fit(homes.limit(0), NAMES, {"m": Settings("prix", trees=2)}, "id_annonce", store)["m"]
    assert none.trees == [] and none.predict(homes).agg(F.max("prediction")).first()[0] == 0.0
    blank = homes.withColumn("prix", F.when(F.col("id_annonce") % 2 == 0, F.col("prix")))
    half = boosting.fit(blank, NAMES, {"m": Settings("prix", trees=1, depth=1, rows=1.0, columns=1.0)},
                        "id_annonce", store, bins=4)["m"]
    only = boosting.fit(blank.where("prix IS NOT NULL"), NAMES, {"m": half.settings}, "id_annonce", store,
                        bins=4)["m"]
    assert half.base == only.base and len(half.trees) == 1


def test_sums_of_open_nodes(spark, homes):
    """Sums by node and bin, after trees that the stored margins lack; nulls and values
    beyond the decimals count as no gradient, on any layout."""
    r = random.Random(2)
    rows = [(i, [r.randint(0, 2), r.randint(0, 1)], r.choice([1.5, -2.25, 7e5, float("nan"), 1e30]),
             0.125, r.random() < .8) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, b array<int>, y double, m_x double, drawn boolean")
    before, tree = [(1, 0, 0.0), (-1, 0, 0.5), (-1, 0, -0.25)], [(0, 1, 0.0)]
    asked = {"x": (Settings("y"), F.col("drawn"), tree, {1, 2})}
    got = [boosting._sums(d, asked, {"x": [before]}, [3, 2]) for d in (df.coalesce(1), df.repartition(7))]
    assert {k: sorted(v) for k, v in got[0].items()} == {k: sorted(v) for k, v in got[1].items()}
    want = {}
    for _, b, y, m, drawn in rows:
        if drawn:
            g = m + (0.5 if b[1] <= 0 else -0.25) - y
            for f in (0, 1):
                own = want.setdefault((1 if b[0] <= 1 else 2, f, b[f]), [0.0, 0.0])
                own[0] += g if abs(g) < 1e28 else 0.0
                own[1] += 1.0
    assert {(n, f, b): [g, h] for (_, n), own in got[0].items() for f, b, g, h in own} == want


def test_catalogue_grows_its_models_whole(spark, homes, monkeypatch):
    from immolens.plans import catalogue
    asked = {}

    class Asked(Exception):
        pass

    def fit(df, features, models, *rest):
        asked.update({n: (s.label, s.loss, s.trees, s.depth, s.rate, s.rows, s.columns) for n, s in models.items()})
        raise Asked
    monkeypatch.setattr(boosting, "fit", fit)
    monkeypatch.setattr(catalogue, "_clustered", lambda spark, sf_dir: (homes.drop("label"), None))
    with pytest.raises(Asked):
        catalogue.second_order_models(spark, "whole")
    assert asked == {"regression_raw": ("prix", "squared", 200, 7, 0.1, 0.8, 0.8),
                     "regression_log": ("prix_log", "squared", 300, 7, 0.1, 0.8, 0.8),
                     "classification": ("label", "logistic", 200, 6, 0.1, 1.0, 1.0)}


def test_cells_give_the_trees_of_the_rows(homes, store, monkeypatch):
    """Over cells, in several parts and records, and level by level over the rows; rows come
    twice, some without a label, and one cell has most of them."""
    some = homes.withColumn("prix", F.when(F.col("id_annonce") % 9 > 0, F.col("prix")))
    many = some.unionByName(some).unionByName(
        some.limit(1).withColumn("id_annonce", F.explode(F.sequence(F.lit(1000), F.lit(1500)))))
    asked = {"raw": Settings("prix", trees=5, depth=4), "clf": Settings("label", "logistic", trees=4, depth=3)}
    for name, size in (("PART_ROWS", 64), ("BLOCK_ROWS", 16), ("TREES", 2), ("RECORD_CELLS", 3)):
        monkeypatch.setattr(boosting.cells, name, size)
    over_cells = boosting.fit(many, NAMES, asked, "id_annonce", store, 8)
    monkeypatch.setattr(boosting.cells, "MOST_CELLS", 0)
    over_rows = boosting.fit(many, NAMES, asked, "id_annonce", store, 8)
    for n, own in asked.items():
        a, b = over_cells[n], over_rows[n]
        assert len(a.trees) == own.trees and a.base == b.base and np.allclose(a.gains, b.gains)
        got, want = ([r.x for r in many.select("id_annonce", m.margin().alias("x")).orderBy("id_annonce", "x").collect()]
                     for m in (a, b))
        assert np.allclose(got, want, rtol=1e-9)
        if own.loss == "squared":
            assert [r.p for r in a.predict(many, "p").orderBy("id_annonce", "p").collect()] == got


def test_draws_are_those_of_the_column(spark):
    ids = spark.range(500).select(F.xxhash64("id").alias("h"))
    h = np.array([r.h for r in ids.collect()])
    got = np.array([list(r) for r in ids.select(*[
        boosting.cells.drawn_column(-3, 0.8, t).alias(f"d_{t}") for t in range(4)]).collect()])
    assert (got == boosting.cells.drawn(h, -3, 0.8, range(4))).all() and 0.75 < got.mean() < 0.85
