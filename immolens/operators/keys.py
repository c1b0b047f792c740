"""Keep-first deduplication (W1) and first-appearance surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL = "ordinal"


def keep_first(df: DataFrame, key: str, ordinal: str = ORDINAL, unique: bool = False) -> DataFrame:
    """One row per ``key``, the one with the smallest ``ordinal``.

    A null ordinal comes last; of rows with the same one, that with the smallest
    hash stays, and of equal rows one, on every run.  Null keys collapse to one
    row; a missing key column is a no-op.

    The first ordinals come from a hash aggregate, combined map-side; the rows
    are then matched by key and order in a hash join without a sort.  A hot
    key's rows are dealt by their order, so none of its rows but the first meets
    another.  ``unique`` says that ordinals are (those that reading a snapshot
    gives): the aggregate then reads two narrow columns instead of hashing rows.
    """
    if key not in df.columns:
        return df
    if unique:
        first = df.groupBy(F.col(key).alias("_key")).agg(F.min(ordinal).alias("_first"))
        return df.join(first.hint("shuffle_hash"), df[key].eqNullSafe(first["_key"])
                       & df[ordinal].eqNullSafe(first["_first"]), "left_semi")
    place = F.coalesce(F.col(ordinal).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    tie = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 48)).cast("decimal(15,0)")
    ordered = df.select(
        "*", F.xxhash64(key).alias("_hash"),
        (place * F.lit(1 << 48).cast("decimal(15,0)") + tie).cast("decimal(38,0)").alias("_order"))
    first = ordered.groupBy(F.col("_hash").alias("_h"), F.col(key).alias("_key")).agg(
        F.min("_order").alias("_first"))
    kept = ordered.join(first.hint("shuffle_hash"),
                        (ordered["_hash"] == first["_h"]) & (ordered["_order"] == first["_first"])
                        & ordered[key].eqNullSafe(first["_key"]), "left_semi")
    return kept.distinct().select(*df.columns)      # rows that are equal in every column


def sequence_ids(df: DataFrame, order_col: str, name: str,
                 slice_width: int = 1 << 20) -> DataFrame:
    """Dense 1-based numbering of ``df`` in ``order_col`` order.

    ``order_col`` holds unique non-negative longs.  A global ``row_number()``
    would sort every row in one task; instead the value range is cut into
    fixed-width slices (``order_col div slice_width``).  Rows are numbered
    inside their slice by a window partitioned on the slice (distributed; a
    slice holds at most ``slice_width`` rows), and each slice is shifted by
    the running total of the counts of the slices before it.  That running
    total is computed over the per-slice count table (one row per slice),
    and everything stays lazy: no action is triggered here.
    """
    tagged = df.withColumn("_slice", F.floor(F.col(order_col) / F.lit(slice_width)))
    offsets = (tagged.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(
                   F.sum("_n").over(Window.orderBy("_slice")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_slice", "_offset"))
    ranked = tagged.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_slice").orderBy(order_col)))
    return (ranked.join(offsets, "_slice")
            .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long"))
            .drop("_slice", "_offset", "_rank"))


def first_seen_ids(df: DataFrame, cols: list[str], name: str, ordinal: str = ORDINAL) -> DataFrame:
    """Distinct ``cols`` tuples numbered in order of first appearance."""
    firsts = df.groupBy(*cols).agg(F.min(ordinal).alias("_first_seen"))
    return sequence_ids(firsts, "_first_seen", name).drop("_first_seen")


def hash_key(*cols: str) -> Column:
    """W4 by value: a 64-bit key that depends on the natural key alone.

    It is the same on every load, in any order and on any layout, and a row's
    foreign key can be computed where the row is, without a look-up.  Nulls count
    as values of their own, wherever they stand.  Two natural keys that meet in a
    key break the dimension's primary key, which the audit (F13) reports; among a
    billion keys that has a chance of about 3 %.
    """
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def hash_ids(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct ``cols`` tuples with their ``hash_key``."""
    return df.select(*cols).distinct().withColumn(name, hash_key(*cols))
