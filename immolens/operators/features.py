"""Feature step (M7): outliers, target encoding, logs, one-hot, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from immolens.functions.numeric import (exact_avg, merged_parts, parts_mean, parts_sum,
                                        sum_parts)
from immolens.functions.text import strip_upper
from immolens.operators.clean import KEY_COLUMNS
from immolens.operators.stats import quantiles, scalars

# Smoothing weight, trimming quantiles.
SMOOTHING = 20
OUTLIER_BOUNDS = (0.01, 0.99)
NON_FEATURES = ["zipcode", "region", "agence", "title"]


def remove_outliers(df: DataFrame, col: str = "prix", lower: float = OUTLIER_BOUNDS[0],
                    upper: float = OUTLIER_BOUNDS[1], rank_error: float | None = None) -> DataFrame:
    """keep ``q(lower) <= col <= q(upper)`` (linear-interpolated quantiles,
    unless a ``rank_error`` is accepted).

    The bounds become literals, so the range filter reaches the scan.
    """
    lo, hi = quantiles(df, col, [lower, upper], rank_error)
    if lo is None:
        return df.where(F.lit(False))
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def fit_target_encoding(df: DataFrame, col: str = "ville", target: str = "prix",
                        smoothing: int = SMOOTHING) -> DataFrame:
    """A2: ``(n * mean_city + k * mean_all) / (n + k)`` per value of ``col``.

    Returns the encoding table ``(col, encoding)`` from one grouped aggregate
    (map-side combined, so a hot city is reduced before the shuffle); the
    global mean is made from its sums and counts, not from another pass.
    Null keys get no encoding.
    """
    by_key = df.groupBy(col).agg(*sum_parts(target, "t"))
    mean = scalars(by_key.agg(*merged_parts("t")).select(parts_mean("t").alias("m")),
                   m=F.first("m"))["m"]
    k = float(smoothing)
    return (by_key.where(F.col(col).isNotNull())
            .select(col, ((F.coalesce(parts_sum("t"), F.lit(0.0))
                           + F.lit(k * mean if mean is not None else None))
                          / (F.col("t_n") + F.lit(smoothing))).alias("encoding")))


def apply_target_encoding(df: DataFrame, encoding: DataFrame, col: str = "ville",
                          on_unknown: str = "null", default: float | None = None,
                          normalise: bool = False) -> DataFrame:
    """Replace ``col`` by its encoding (left join on the table).

    ``normalise`` upper-cases and strips the lookup key first (new rows);
    ``on_unknown``: ``null`` keeps a null, ``default`` uses ``default`` (or
    the unweighted mean of all encodings, A19), ``error`` raises when any
    value is unknown.  The encoding table has one row per city; no broadcast
    hint is given, AQE broadcasts it when its measured size is small.
    """
    key = strip_upper(col) if normalise else F.col(col)
    enc = encoding.select(F.col(col).alias("_key"), F.col("encoding").alias("_enc"))
    joined = df.withColumn("_key", key).join(enc, "_key", "left")
    if on_unknown == "error":
        missing = joined.where(F.col("_enc").isNull() & F.col("_key").isNotNull()).limit(1).count()
        if missing:
            raise KeyError(f"unknown values in {col!r} for the saved encoding")
    if on_unknown == "default":
        if default is None:
            default = encoding.agg(exact_avg("encoding")).first()[0]
        joined = joined.withColumn("_enc", F.coalesce("_enc", F.lit(default)))
    return joined.withColumn(col, F.col("_enc")).drop("_key", "_enc").select(*df.columns)


def target_encode_ville(df: DataFrame, target_col: str = "prix",
                        smoothing: int = SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """Fit on ``df`` and apply to it; returns ``(encoded, encoding_table)``."""
    enc = fit_target_encoding(df, "ville", target_col, smoothing)
    return apply_target_encoding(df, enc, "ville"), enc


def add_derived_features(df: DataFrame) -> DataFrame:
    """``prix_log = ln(1 + prix)``, ``surface_log = ln(1 + surface)``."""
    return df.withColumns({"prix_log": F.log1p("prix"), "surface_log": F.log1p("surface")})


def drop_non_features(df: DataFrame, columns=NON_FEATURES) -> DataFrame:
    """P3."""
    return df.drop(*[c for c in columns if c in df.columns])


def one_hot_vocabulary(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct values of a column: its flags' names.  They become
    columns of the plan, so they come to the driver, however many there are."""
    return sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().collect())


def encode_categoricals(df: DataFrame, vocabularies: dict | None = None,
                        exclude=KEY_COLUMNS) -> DataFrame:
    """M3: one boolean column ``{col}_{VALUE}`` per level of each text column.

    No level is dropped; a null value is false everywhere; the text column is
    replaced by its flags (a projection, no shuffle).
    """
    vocabularies = dict(vocabularies or {})
    text_cols = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, StringType) and f.name not in exclude]
    out = []
    for f in df.schema.fields:
        if f.name not in text_cols:
            out.append(F.col(f.name))
            continue
        vocab = vocabularies.get(f.name) or one_hot_vocabulary(df, f.name)
        out += [F.coalesce(F.col(f.name) == F.lit(v), F.lit(False)).alias(f"{f.name}_{v}")
                for v in vocab]
    return df.select(*out)


def engineer_features(df: DataFrame, n_cluster: int | None = 8, cluster_cols=None,
                      seed: int = 42):
    """M7: dropna(prix) -> outliers -> encoding -> logs -> drop -> one-hot -> KMeans.

    Returns ``(features, encoding_table, kmeans_model_or_None)``;
    ``n_cluster=None`` skips clustering.  The step reads its input several
    times (quantiles, levels, global mean, output): pass a stored table.
    """
    from immolens.operators import models  # local import: MLlib is heavy

    out = df.where(F.col("prix").isNotNull()) if "prix" in df.columns else df
    out = remove_outliers(out)
    out, enc = target_encode_ville(out)
    out = encode_categoricals(drop_non_features(add_derived_features(out)))
    model = None
    if n_cluster:
        out, model = models.train_clustering(out, n_cluster, cluster_cols, seed)
    return out, enc, model
