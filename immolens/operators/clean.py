"""Cleaning step (M2): rename, select, dedupe, hash, parse, normalise, impute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from immolens.functions.numeric import exact_avg
from immolens.functions.text import numeric_text, sha256_hex, strip_upper
from immolens.operators.keys import ORDINAL, keep_first

# Raw -> model column names, dropped columns, kept columns.
COLUMN_MAPPING = {
    "id": "id_annonce",
    "title": "title",
    "type": "type_bien",
    "price": "prix",
    "city": "ville",
    "author": "agence",
}
COLUMNS_TO_DROP = ["category", "url", "image_url", "contact", "suspicious", "score",
                   "created_at", "updated_at", "price_m2"]
USEFUL_COLUMNS = ["id_annonce", "prix", "surface", "pieces", "type_bien", "ville",
                  "zipcode", "region", "agence"]
KEY_COLUMNS = ("id", "id_annonce", ORDINAL)


def rename_columns(df: DataFrame) -> DataFrame:
    """Raw names -> model names (present columns only), drop nine columns."""
    mapping = {k: v for k, v in COLUMN_MAPPING.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(mapping).drop(*[c for c in COLUMNS_TO_DROP if c in df.columns])


def select_features(df: DataFrame, keep=(ORDINAL,)) -> DataFrame:
    """The useful columns in fixed order (plus internal ``keep`` columns)."""
    return df.select(*[c for c in USEFUL_COLUMNS if c in df.columns],
                     *[c for c in keep if c in df.columns])


def manage_duplicates(df: DataFrame, id_col: str = "id_annonce", ordinal: str = ORDINAL,
                      unique: bool = False) -> DataFrame:
    """Keep the first row per id (smallest ordinal); no id column = no-op.
    ``unique`` as for ``keep_first``.

    Rows without an order have no first one: the row with the smallest hash is
    kept then, the same on every run.
    """
    if ordinal in df.columns or id_col not in df.columns:
        return keep_first(df, id_col, ordinal, unique)
    hashed = df.distinct().withColumn(ordinal, F.xxhash64(*df.columns))
    return keep_first(hashed, id_col, ordinal).drop(ordinal)


def hash_contact_names(df: DataFrame, columns=("agence",)) -> DataFrame:
    """SHA-256 pseudonymisation of the given columns (null stays null)."""
    return df.withColumns({c: sha256_hex(c) for c in columns if c in df.columns})


def clean_numerical_columns(df: DataFrame, columns=("prix", "surface")) -> DataFrame:
    """Parse text numbers ('150 000 €', '45 m²').  Numbers pass through."""
    todo = {c: numeric_text(c) for c in columns
            if c in df.columns and isinstance(df.schema[c].dataType, StringType)}
    return df.withColumns(todo) if todo else df


def normalize_text_columns(df: DataFrame, columns=("ville", "type_bien")) -> DataFrame:
    """Strip + upper-case (null stays null)."""
    return df.withColumns({c: strip_upper(c) for c in columns if c in df.columns})


def numeric_columns(df: DataFrame, exclude=KEY_COLUMNS) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def column_means(df: DataFrame, columns: list[str]) -> dict:
    """Means of several columns in one aggregate job (a single row comes back)."""
    if not columns:
        return {}
    row = df.agg(*[exact_avg(c).alias(c) for c in columns]).first()
    return row.asDict()


def impute_missing_values(df: DataFrame, strategy: str = "mean", columns=None) -> DataFrame:
    """A1: fill nulls of numeric columns with the column mean.

    Key columns are never imputed; an all-null column stays null; strategies
    other than ``mean`` leave the frame unchanged.  Means come from exact
    sums, so they do not depend on partitioning.
    """
    if strategy != "mean":
        return df
    cols = list(columns) if columns is not None else numeric_columns(df)
    means = column_means(df, [c for c in cols if c in df.columns])
    fills = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in means.items() if m is not None}
    return df.withColumns(fills) if fills else df


def clean_listings(df: DataFrame, numeric_cols=("prix", "surface", "pieces"),
                   text_cols=("ville", "type_bien"), hash_cols=("agence",),
                   id_col: str = "id_annonce",
                   store: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None
                   ) -> DataFrame:
    """M2: rename -> select -> dedupe -> hash -> parse -> normalise -> impute.
    The ordinals are those of a read snapshot, so no two rows share one.

    Deduplication and imputation read their input twice.  ``store(name, make)``
    writes a table and reads it back, so that what comes before (the title repair,
    the join) is done once."""
    def kept(name, out):
        return store(name, lambda: out) if store else out

    out = kept("selected", select_features(rename_columns(df)))
    out = kept("first", manage_duplicates(out, id_col, unique=True))
    out = hash_contact_names(out, hash_cols)
    out = clean_numerical_columns(out, numeric_cols)
    out = normalize_text_columns(out, text_cols)
    out = impute_missing_values(out, "mean")
    return out.drop(ORDINAL) if ORDINAL in out.columns else out
