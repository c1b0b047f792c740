"""Exact quantiles: the sliced selection equals Spark's percentile."""

import random

import pytest
from pyspark.sql import functions as F

from immolens.operators import stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def percentile(df, value, probs=PROBS):
    got = df.agg(F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("p")).first()[0]
    return list(got) if got is not None else [None] * len(probs)


@pytest.fixture()
def skewed(spark):
    rnd = random.Random(7)
    rows = [(round(rnd.lognormvariate(12, 1), 2), rnd.choice("AB")) for _ in range(4000)]
    rows += [(150000.0, "A")] * 2000          # one value holds a third of the rows
    rows += [(None, "B")] * 5
    return spark.createDataFrame(rows, "p double, t string")


def test_matches_percentile(skewed):
    assert stats.quantiles(skewed, "p", PROBS) == percentile(skewed, F.col("p"))


def test_several_measures_in_one_call(skewed):
    measures = [(F.col("p"), F.col("t") == "A"), (F.col("p") * -2, F.col("t") == "B"),
                (F.col("p"), F.col("t") == "none"), (F.length("t"), None)]
    expected = [percentile(skewed.where(c) if c is not None else skewed, v) for v, c in measures]
    assert stats.quantile_table(skewed, measures, PROBS) == expected


def test_empty(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("p"))
    assert stats.quantiles(df, "p", [0.1, 0.9]) == pytest.approx([9.9, 89.1])
    assert stats.quantiles(df.where("p < 0"), "p", [0.5]) == [None]
    assert stats.quantile_table(df, [], [0.5]) == []


def test_underestimated_plan(spark):
    """A plan whose size Catalyst cannot see goes the same way as any other."""
    df = (spark.range(50).select(F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("x"), "id")
          .select((F.col("x") * 1.25 + F.col("id") % 3).alias("p")))
    assert stats.quantiles(df, "p", PROBS) == percentile(df, F.col("p"))


@pytest.mark.parametrize("values", [
    [float(2.0 ** k) for k in range(-300, 300, 7)] + [-1e300, 1e300],
    [2.0 ** k + d for k in range(1, 60) for d in (-0.5, 0, 0.5)],
    [5e-324, 1e-310, 0.0, -0.0, -5e-324, 1.0, 1.0, 1.0],
    [float("inf"), float("-inf"), 0.1, -0.1, 7.0],
    [-3.0, -2.999999, -2.0, -1.5, 1e17, 1e17 + 16, 123456.78]])
def test_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "p double").repartition(3)
    assert stats.quantiles(df, "p", [0.1, 0.5, 0.9]) == percentile(df, F.col("p"), [0.1, 0.5, 0.9])


def test_slices_follow_the_values(spark):
    rnd = random.Random(3)
    values = sorted({rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randrange(-300, 300)
                     for _ in range(3000)} | {0.0, float("inf"), float("-inf")})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", stats.value_slice(F.col("v")).alias("s")).collect()
    slices = [r["s"] for r in sorted(rows, key=lambda r: r["v"])]
    assert slices == sorted(slices)


def test_where_projected(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    out = stats.where_projected(df, F.col("x") > 1)
    assert [r.x for r in out.collect()] == [2] and out.columns == ["x"]
