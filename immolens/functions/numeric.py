"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trunc_long(col) -> Column:
    """C11: truncating integer conversion (int(x) in Python); null-safe."""
    return _c(col).try_cast("long")


# Sums are kept in decimals of this type: they do not depend on the order in
# which partitions are merged (a double sum does), and hold 28 whole digits.
EXACT = "decimal(38,10)"


def exact(col) -> Column:
    c = _c(col).cast("double")
    return F.when(F.abs(c) < F.lit(1e28), c).try_cast(EXACT)


def _odd(col) -> Column:
    """Infinite, undefined or beyond the decimals."""
    c = _c(col).cast("double")
    return F.isnan(c) | (F.abs(c) >= F.lit(1e28))


# ---- a sum in mergeable parts: of a column's rows first, then of such rows
def sum_parts(col, name: str) -> list[Column]:
    """Partial aggregates of a column: its exact sum (null if no decimal holds it),
    its plain sum, how many values it has and how many of them have no decimal."""
    return [F.try_sum(exact(col)).alias(f"{name}_exact"),
            F.sum(_c(col).cast("double")).alias(f"{name}_plain"),
            F.count(_c(col)).alias(f"{name}_n"), F.count_if(_odd(col)).alias(f"{name}_odd")]


def merged_parts(name: str) -> list[Column]:
    """The same four of rows of parts."""
    lost = F.count_if(F.col(f"{name}_exact").isNull() & (F.col(f"{name}_n") > F.col(f"{name}_odd")))
    return [F.when(lost == 0, F.try_sum(f"{name}_exact")).alias(f"{name}_exact"),
            *[F.sum(f"{name}_{x}").alias(f"{name}_{x}") for x in ("plain", "n", "odd")]]


def parts_sum(name: str) -> Column:
    """The sum as a double: exact unless a value or the sum has no decimal."""
    return F.when(F.col(f"{name}_odd") == 0, F.coalesce(
        F.col(f"{name}_exact").cast("double"), F.col(f"{name}_plain"))) \
        .otherwise(F.col(f"{name}_plain"))


def parts_mean(name: str) -> Column:
    return parts_sum(name) / F.nullif(F.col(f"{name}_n"), F.lit(0))


def parts_round_mean(name: str, dp: int) -> Column:
    """Half-up rounding of the exact mean; of the plain one where there is none."""
    n = F.nullif(F.col(f"{name}_n"), F.lit(0))
    ratio = F.round(F.try_divide(F.col(f"{name}_exact"), n.cast("decimal(20,0)")), dp).cast("double")
    plain = F.round(F.col(f"{name}_plain") / n, dp)
    return F.when(F.col(f"{name}_odd") == 0, F.coalesce(ratio, plain)).otherwise(plain)


# ---- the same in one aggregate
def exact_sum(col) -> Column:
    """The sum as a double, from a decimal sum; the plain sum of a group that
    holds infinite, undefined or huge values."""
    plain = F.sum(_c(col).cast("double"))
    return F.when(F.count_if(_odd(col)) == 0, F.coalesce(
        F.try_sum(exact(col)).cast("double"), plain)).otherwise(plain)


def exact_avg(col) -> Column:
    """The mean at full precision, the same on every cluster layout."""
    return exact_sum(col) / F.nullif(F.count(_c(col)), F.lit(0))


def round_avg(col, dp: int) -> Column:
    """C12 on an average: half-up rounding of the exact mean."""
    plain = F.round(F.avg(_c(col).cast("double")), dp)
    mean = F.try_divide(F.try_sum(exact(col)), F.count(_c(col)).cast("decimal(20,0)"))
    return F.when(F.count_if(_odd(col)) == 0, F.coalesce(F.round(mean, dp).cast("double"), plain)) \
        .otherwise(plain)


def spaced_thousands(col) -> Column:
    """1234567 -> '1 234 567'."""
    return F.replace(F.format_number(_c(col), 0), F.lit(","), F.lit(" "))
