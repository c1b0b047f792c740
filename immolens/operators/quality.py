"""Data quality step (M1): title repair (C4-C7, P4, P5) then constraints (F1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from immolens.operators.stats import where_projected
from immolens.functions.text import (is_blank, rooms_from_title, surface_from_title,
                                     type_from_title)

# The quality rules, on raw column names.
PRICE_M2_LIMIT = 50000


def _as_number(df: DataFrame, name: str) -> Column:
    """Numeric coercion; NaN is treated as missing (SQL NULL)."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        c = c.cast("double")
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
    return c.try_cast("double")


def extract_m2(df: DataFrame) -> DataFrame:
    """Fill ``surface``/``pieces``/``type`` from the title; recompute ``price_m2``.

    Missing ``surface``/``pieces`` columns are created empty (P4); only null
    values are filled; ``price_m2 = price / surface`` (null when surface is
    null or zero, P5).
    """
    cols = set(df.columns)
    for name in ("surface", "pieces"):
        df = df.withColumn(name, _as_number(df, name) if name in cols
                           else F.lit(None).cast("double"))
    if "title" in cols:
        df = df.withColumns({
            "surface": F.coalesce(F.col("surface"), surface_from_title("title")),
            "pieces": F.coalesce(F.col("pieces"), rooms_from_title("title")),
        })
        if "type" in cols:
            df = df.withColumn("type", type_from_title("type", "title"))
    price_m2 = (F.try_divide(F.col("price").cast("double"), F.col("surface"))
                if "price" in cols else F.lit(None).cast("double"))
    return df.withColumn("price_m2", price_m2)


def rule_predicates(columns) -> dict[str, Column]:
    """F1 rules for the columns present; a null value fails its rule."""
    rules = {
        "price": lambda c: c.isNotNull() & (c > 0),
        "surface": lambda c: c.isNotNull() & (c > 0),
        "price_m2": lambda c: c.isNotNull() & (c < PRICE_M2_LIMIT),
        "city": lambda c: ~is_blank(c),
        "type": lambda c: ~is_blank(c),
    }
    return {name: rule(F.col(name)) for name, rule in rules.items() if name in columns}


def passes(columns) -> Column:
    preds = list(rule_predicates(columns).values())
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def validate_constraints(df: DataFrame) -> DataFrame:
    """all rules.  Those on columns that the title repair leaves alone are
    a plain filter, which reaches the scan; the others are projected once."""
    untouched = [c for c in df.columns if c in ("price", "city")]
    repaired = [c for c in df.columns if c not in ("price", "city")]
    return where_projected(df.where(passes(untouched)), passes(repaired))


def data_quality(df: DataFrame) -> DataFrame:
    """M1: ``extract_m2`` then ``validate_constraints``."""
    return validate_constraints(extract_m2(df))


def rule_counts(df: DataFrame) -> DataFrame:
    """Rows in, rows rejected by each rule (a row may fail several), rows out.

    One aggregate pass with ``count_if`` per rule.
    """
    df = extract_m2(df)
    rules = rule_predicates(df.columns)
    aggs = [F.count(F.lit(1)).alias("rows_in")]
    aggs += [F.count_if(~pred).alias(f"{name}_rejected") for name, pred in rules.items()]
    aggs.append(F.count_if(passes(df.columns)).alias("rows_out"))
    return df.agg(*aggs)


def rejected_rows(df: DataFrame, key_cols=("id", "ordinal")) -> DataFrame:
    """U2 row-level: the rows the quality step drops, with the first failed rule.

    The complement of the filter; no join against the kept rows is needed.
    """
    df = extract_m2(df)
    reason = F.lit(None).cast("string")
    for name, pred in reversed(list(rule_predicates(df.columns).items())):
        reason = F.when(~pred, F.lit(name)).otherwise(reason)
    keys = [c for c in key_cols if c in df.columns]
    return where_projected(df, ~passes(df.columns)).select(*keys, reason.alias("failed_rule"))
