"""Sketches: the stated rank error, merging in any order, exact by default."""

import random

import pytest
from pyspark.sql import functions as F

from immolens.operators import features, market, sketches, stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def prices(spark):
    r = random.Random(6)
    rows = [(f"2024-0{i % 3 + 1}", r.choice("AMT"), round(r.lognormvariate(12, 1), 2)) for i in range(30_000)]
    return spark.createDataFrame(rows + [("2024-01", "A", None), ("2024-01", "A", float("nan"))],
                                 "snapshot string, type string, prix double")


def ranks(values, v):
    """The shares of values below v, and up to it."""
    return sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_rank_error_holds_after_merging(prices, error):
    own = sketches.sketch_table(prices, {"prix": F.col("prix")}, error, ("snapshot", "type"))
    values = {t: [r.prix for r in prices.where(f"type = '{t}' AND prix > 0 AND NOT isnan(prix)").collect()]
              for t in "AM"}
    for t, some in values.items():
        got = sketches.sketch_quantiles(own.where(f"type = '{t}'"), "prix", PROBS)
        for p, v in zip(PROBS, got, strict=True):
            low, high = ranks(some, v)
            assert low - error <= p <= high + error, (t, p)
    by_type = sketches.merged_sketches(own, ["prix"], ("type",))
    assert by_type.count() == 3
    both = [x for some in values.values() for x in some]
    got = sketches.sketch_quantiles(by_type.where("type <> 'T'"), "prix", [0.5])[0]
    low, high = ranks(both, got)
    assert low - error <= 0.5 <= high + error


def test_exact_is_the_default(prices):
    exact = stats.quantiles(prices.where("NOT isnan(prix)"), "prix", [0.5])[0]
    assert exact == prices.where("NOT isnan(prix)").agg(F.median("prix")).first()[0]
    near = stats.quantiles(prices, "prix", [0.5], rank_error=0.01)[0]
    assert abs(near / exact - 1) < 0.1
    kept = features.remove_outliers(prices.where("NOT isnan(prix)"), rank_error=0.005).count()
    assert abs(kept - features.remove_outliers(prices.where("NOT isnan(prix)")).count()) < 0.02 * 30_000
    raw = spark_rows(prices.sparkSession)
    a, b = (market.market_alerts(raw, rank_error=e).collect() for e in (None, 0.01))
    assert [r.zone for r in a] == [r.zone for r in b]
    assert all(abs(x.vs_median_pct - y.vs_median_pct) < 8 for x, y in zip(a, b, strict=True))


def spark_rows(spark):
    return spark.range(4000).select(F.concat(F.lit("c"), F.col("id") % 9).alias("city"),
                                    (F.col("id") % 997 + 1000.0).alias("price"), F.lit(2.0).alias("surface"))


def test_no_values_and_bad_errors(spark, prices):
    none = prices.where("prix IS NULL")
    assert stats.quantiles(none, "prix", [0.1, 0.5], rank_error=0.05) == [None, None]
    assert stats.quantiles(prices.limit(0), "prix", [0.5], rank_error=0.05) == [None]
    assert features.remove_outliers(none, rank_error=0.05).count() == 0
    empty = sketches.sketch_table(prices.limit(0), {"prix": F.col("prix")}, 0.05, ("type",))
    assert empty.count() == 0 and sketches.sketch_quantiles(empty, "prix", [0.5]) == [None]
    for bad in (0, 1, -0.1, 1e-6):
        with pytest.raises(ValueError):
            sketches.sketch_size(bad)
    assert sketches.sketch_size(0.0133) in range(195, 206)
