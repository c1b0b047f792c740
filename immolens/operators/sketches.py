"""Mergeable quantile sketches, where a stated rank error is accepted.

Exact quantiles (``stats.quantile_table``, the panel cube) are the default
everywhere.  A sketch answers within a share of ranks: the value returned for
0.5 lies between the quantiles 0.5 - e and 0.5 + e (with 99 % confidence for
each answer).  What it buys is that sketches are small and merge in any order:
one per (snapshot, type), stored when a snapshot is loaded, answers for any set
of snapshots and types without reading a row again.

Spark's KLL aggregates do the work; nulls and NaN are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_SIZES = (8, 65_535)      # of a KLL sketch, as Spark takes them


def sketch_size(rank_error: float) -> int:
    """The KLL size whose normalised rank error is at most ``rank_error``
    (2.296 / size^0.9723, the sketch's published bound)."""
    if not 0 < rank_error < 1:
        raise ValueError("a rank error is a share between 0 and 1")
    size = math.ceil((2.296 / rank_error) ** (1 / 0.9723))
    if size > SKETCH_SIZES[1]:
        raise ValueError(f"no sketch is that exact: {rank_error}; use exact quantiles")
    return max(SKETCH_SIZES[0], size)


def sketch_table(df: DataFrame, measures: dict[str, Column], rank_error: float,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with a sketch (binary) of each measure, combined map-side."""
    size = F.lit(sketch_size(rank_error))

    def ordinary(c: Column) -> Column:
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(ordinary(c), size).alias(name)
                                 for name, c in measures.items()])


def merged_sketches(sketches: DataFrame, measures: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of finer groups, or of several snapshots, as one per group."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(m).alias(m) for m in measures])


def sketch_quantiles(sketches: DataFrame, measure: str, probs) -> list[float | None]:
    """Quantiles of all values behind the sketches; None where there is no value."""
    one = merged_sketches(sketches.where(F.col(measure).isNotNull()), [measure])
    has = F.kll_sketch_get_n_double(measure) > 0
    row = one.select(*[F.when(has, F.kll_sketch_get_quantile_double(measure, F.lit(float(p))))
                       .alias(f"q{i}") for i, p in enumerate(probs)]).first()
    return list(row) if row else [None] * len(probs)
