"""Global statistics (J9): one aggregate job, one row back to the driver.

A global statistic (mean, quantile, median) is a barrier by nature.  It is
computed over the whole column by one distributed job and returned as a few
scalars, which are then used as literals.  Literals keep later filters
pushable to the parquet scan and avoid joining every row to a one-row table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# A slice holds the values that share sign, exponent and this many of the
# leading steps of an octave: at most 2^24 slices of a measure, at any size.
SLICE_STEPS = 4096


def value_slice(v: Column) -> Column:
    """A long that never falls when the double ``v`` rises (NaN comes last)."""
    size = F.abs(v)
    octave = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1074)), F.lit(1023))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * SLICE_STEPS)
    place = ((octave + 1075) * SLICE_STEPS
             + F.least(F.greatest(step, F.lit(0)), F.lit(SLICE_STEPS - 1)))
    return (F.when(F.isnan(v), F.lit(1 << 24)).when(v == 0, F.lit(0))
            .when(v < 0, -place).otherwise(place).cast("long"))


def quantile_table(df: DataFrame, measures: list[tuple[Column, Column | None]],
                   probs) -> list[list]:
    """Quantiles of several ``(value, condition or None)`` measures in one job.

    Exact, with Spark's ``percentile`` interpolation; nulls are ignored and a
    measure without a value gives ``None``.  One way for every size: values
    are counted by ``(measure, value)`` with partial sums, so that a hot value
    is one row; the distinct values fall into ordered slices, whose totals
    tell which slice holds a wanted rank; and only those slices are sorted.
    ``len(measures) * len(probs) * 2`` rows come back.
    """
    if not measures:
        return []
    items = [F.when((c if c is not None else F.lit(True)) & v.isNotNull(),
                    F.struct(F.lit(i).alias("m"), v.cast("double").alias("v")))
             for i, (v, c) in enumerate(measures)]
    # nulls are left out after the generator, as ``cube._long`` does it
    counts = (df.select(F.explode(F.array(*items)).alias("x")).where(F.col("x").isNotNull())
              .select(F.col("x.m").alias("m"), F.col("x.v").alias("v"))
              .groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("s", value_slice(F.col("v"))))
    by_measure = Window.partitionBy("m")
    upto = by_measure.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(*[F.transform(F.array(F.floor(F.lit(float(p)) * (F.col("total") - 1)),
                                          F.ceil(F.lit(float(p)) * (F.col("total") - 1))),
                                  lambda r: r.cast("long")) for p in probs])
    wanted = (counts.groupBy("m", "s").agg(F.sum("n").alias("n"))
              .select("m", "s", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n",
                      F.sum("n").over(by_measure).alias("total"))
              .select("m", "s", "before", "n", "total",
                      F.explode(F.array_distinct(F.flatten(ranks))).alias("r"))
              .where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
              .drop("n"))
    inside = Window.partitionBy("m", "s").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (counts.join(wanted.groupBy("m", "s").agg(
                 F.first("before").alias("before"), F.first("total").alias("total"),
                 F.collect_set("r").alias("ranks")), ["m", "s"])
             .withColumn("upto", F.col("before") + F.sum("n").over(inside))
             .select("m", "v", "total", F.explode(F.filter(
                 "ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto"))))
                 .alias("r")))
    value, total = {}, {}
    for row in found.collect():
        value[row["m"], row["r"]] = row["v"]
        total[row["m"]] = row["total"]
    def at(i, p):
        place = float(p) * (total[i] - 1)
        return interpolate(value[i, math.floor(place)], value[i, math.ceil(place)], place)

    return [[at(i, p) if i in total else None for p in probs] for i in range(len(measures))]


def interpolate(low: float, high: float, place: float) -> float:
    """Spark's percentile interpolation between the values at the ranks beside ``place``."""
    lo, hi = math.floor(place), math.ceil(place)
    if lo == hi or low == high:
        return low
    return (hi - place) * low + (place - lo) * high


def quantiles(df: DataFrame, col: str, probs, rank_error: float | None = None) -> list:
    """Quantiles of one column as Python floats (None if there is no value): exact,
    or within a ``rank_error`` from one pass (``operators/sketches``)."""
    if rank_error is None:
        return quantile_table(df, [(F.col(col), None)], probs)[0]
    from immolens.operators.sketches import sketch_quantiles, sketch_table
    return sketch_quantiles(sketch_table(df, {"v": F.col(col)}, rank_error), "v", probs)


def scalars(df: DataFrame, **aggs: Column) -> dict:
    """Several global aggregates in one job: ``scalars(df, n=F.count('*'))``."""
    return df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()


def where_projected(df: DataFrame, predicate: Column) -> DataFrame:
    """``df.where(predicate)`` for predicates over expensive derived columns.

    A plain ``where`` is pushed below the projection that derives the
    columns, with every derived expression inlined into the condition (one
    copy per reference), and the filter operator does not eliminate common
    subexpressions.  Here the predicate is projected once (with subexpression
    elimination) and rows are kept by a generator that emits one or zero
    rows; Catalyst does not push a filter below a generator.  Measured on the
    title repair at sf0.1: 1.3 s instead of 4.2 s.
    """
    kept = F.explode(F.when(F.col("_keep"), F.array(F.lit(True)))
                     .otherwise(F.array().cast("array<boolean>"))).alias("_kept")
    return df.withColumn("_keep", predicate).select(*df.columns, kept).drop("_kept")
