"""End-to-end jobs: preparation (M18), warehouse (M19 + S9-S12), training."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from immolens.operators import (bundle, clean, features, market, marts, models, quality,
                                warehouse)
from immolens.plans import views
from immolens.sources import manifest, snapshots

# (listing column, dimension column) pairs forming each natural key
NATURAL_KEYS = {"dim_type": [("type", "type_name")],
                "dim_location": [("city", "city"), ("zipcode", "zipcode"), ("region", "region")],
                "dim_author": [("author", "id_author")],
                "dim_date": [("created_at", "created_at")]}
SURROGATE_KEYS = {"dim_type": "id_type", "dim_location": "id_location", "dim_date": "id_date"}
STAR = (*warehouse.DIMENSIONS, "fact_ads", "mart_parts")


def prepare(spark: SparkSession, raw: DataFrame, out_dir: str,
            snapshot_date: str | None = None, n_cluster: int = 8, seed: int = 42,
            fmt: str = "parquet") -> dict:
    """Quality -> clean -> features -> write the ML-ready snapshot.

    Stage row counts (S19) are ``observe()`` metrics collected while the
    stages run, not extra passes.  The cleaned rows are stored once (the feature
    step reads them for several global statistics).  The city encoding and the clustering model are saved next to
    the data (S13, S14).  Returns the output path and the stage audit.
    """
    snapshot_date = snapshot_date or dt.date.today().isoformat()
    obs = {name: Observation(name) for name in ("ingest", "quality", "clean", "features")}
    rows = F.count(F.lit(1)).alias("rows")
    seen = raw.observe(obs["ingest"], rows)
    checked = quality.data_quality(seen).observe(obs["quality"], rows)
    cleaned = snapshots.stored(
        spark, "prepared", f"{out_dir}|{snapshot_date}|{uuid.uuid4()}",
        lambda: clean.clean_listings(checked).observe(obs["clean"], rows))
    feats, enc, km = features.engineer_features(cleaned, n_cluster=n_cluster, seed=seed)
    feats = feats.observe(obs["features"], rows)
    data_path = snapshots.write_clean(feats, os.path.join(out_dir, "clean"), snapshot_date, fmt)
    snapshots.save_encoding(enc, os.path.join(out_dir, "models", "city_encoding"))
    if km is not None:
        snapshots.save_model(km, os.path.join(out_dir, "models", "kmeans"))
    counts = [obs[n].get.get("rows", 0) for n in ("ingest", "quality", "clean", "features")]
    names = ["ingest", "quality", "clean", "features"]
    audit = [(i, names[i], counts[max(i - 1, 0)], counts[i], counts[max(i - 1, 0)] - counts[i])
             for i in range(4)]
    return {"data": data_path, "snapshot_date": snapshot_date,
            "audit": spark.createDataFrame(
                audit, "stage_order int, stage string, rows_in long, rows_out long, dropped long")}


def build_warehouse(spark: SparkSession, raw: DataFrame, out_dir: str,
                    mode: str = "overwrite", keys: str = "sequence") -> dict[str, DataFrame]:
    """M19 + S9/S11/S12: write the star and the parts of its marts, publish them,
    register the tables and the three mart views, and return the tables read back.

    Tables go to a folder of their own and are seen once all of them are written
    (``sources/manifest``): a load that dies leaves the version before it as it is.
    ``mode='overwrite'`` starts the schema anew (S11).  ``mode='append'`` adds only
    new dimension rows and new fact ids (``left_anti`` on the natural and primary
    keys) beside the folders of the version before, so loading a snapshot again
    changes nothing; the marts' parts are made of the new facts alone.  ``keys``
    as for ``warehouse.build_star``; an append keeps those of the star.
    """
    own = manifest.current(spark, out_dir) if mode == "append" else None
    folder = manifest.new_folder(out_dir)
    keys = own["keys"] if own else keys
    paths = {name: list(own["tables"][name]) if own else [] for name in STAR}
    listings = warehouse.prepare_raw(raw)

    def add(name: str, rows: DataFrame) -> DataFrame:
        """The table with its new rows, written."""
        path = f"{folder}/{name}"
        rows.write.parquet(path)
        if not paths[name] or not spark.read.parquet(path).isEmpty():
            paths[name].append(path)
        return spark.read.parquet(*paths[name])

    dims = {}
    for name, build in warehouse.DIMENSIONS.items():
        if not own:
            dims[name] = add(name, build(listings, keys))
            continue
        # listings whose natural key is not stored yet (null-safe, as J2)
        old = spark.read.parquet(*paths[name])
        pairs = NATURAL_KEYS[name]
        known = old.select(*[F.col(d).alias(f"_old_{d}") for _, d in pairs])
        same = [listings[s].eqNullSafe(known[f"_old_{d}"]) for s, d in pairs]
        new = build(listings.join(known, reduce(lambda a, b: a & b, same), "left_anti"), keys)
        sk = SURROGATE_KEYS.get(name)
        if sk and keys == "sequence":       # numbered among themselves, after the stored ones
            top = old.agg(F.max(sk)).first()[0] or 0
            new = new.withColumn(sk, F.col(sk) + F.lit(top))
        dims[name] = add(name, new)
    fact = warehouse.fact_by_hash(listings) if keys == "hash" else warehouse.fact_ads(
        listings, dims["dim_type"], dims["dim_location"], dims["dim_date"])
    if own:
        stored = spark.read.parquet(*paths["fact_ads"]).select("id_annonce")
        fact = fact.join(stored, "id_annonce", "left_anti")
    add("fact_ads", fact)
    add("mart_parts", marts.fact_parts(spark.read.schema(fact.schema).parquet(f"{folder}/fact_ads")))
    manifest.publish(spark, out_dir, {"tables": paths, "keys": keys})
    tables = load_warehouse(spark, out_dir)
    register_views(tables)
    return tables


def load_warehouse(spark: SparkSession, out_dir: str, version: int | None = None
                   ) -> dict[str, DataFrame]:
    """The tables of the newest (or the given) version."""
    own = manifest.current(spark, out_dir, version)
    if own is None:
        raise FileNotFoundError(f"no warehouse {version or ''} in {out_dir}")
    return {name: spark.read.parquet(*own["tables"][name]) for name in STAR}


def register_views(tables: dict[str, DataFrame]) -> None:
    """The star tables and the three marts as temporary views
    (replaced when they exist)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    views.create_mart_views(next(iter(tables.values())).sparkSession, tables)


def preview(spark: SparkSession, view: str = "dm_stats_par_ville", n: int = 5) -> DataFrame:
    """The first rows of a mart view."""
    return spark.table(view).limit(n)


def train(spark: SparkSession, feats: DataFrame, out_dir: str, raw_params=None,
          log_params=None, clf_params=None) -> dict:
    """Boosted models on the ML-ready rows; the champion is published as a
    bundle with the encoding and clustering that ``prepare`` saved (S13-S16).
    Returns the ``models.train_models`` result."""
    res = models.train_models(feats, raw_params, log_params, clf_params)
    if res:
        saved = os.path.join(out_dir, "models")
        clusters = None
        if "cluster" in res["feature_columns"]:
            clusters = models.Clusters.of_model(
                snapshots.load_pipeline_model(os.path.join(saved, "kmeans")))
        encoding = snapshots.load_encoding(spark, os.path.join(saved, "city_encoding"))
        ranges = market.input_ranges(feats).first().asDict()
        bundle.save(spark, bundle_folder(out_dir),
                    bundle.of_training(res, encoding, clusters, ranges))
    return res


def bundle_folder(out_dir: str) -> str:
    return os.path.join(out_dir, "models", "bundle")


def score_requests(spark: SparkSession, requests: DataFrame, out_dir: str,
                   version: int | None = None) -> DataFrame:
    """A table of requests scored with the newest (or the given) bundle of
    ``out_dir``; nothing but the folder is needed."""
    return bundle.score(requests, bundle.load(spark, bundle_folder(out_dir), version))


def run_report(spark: SparkSession, raw: DataFrame, out_dir: str) -> dict[str, DataFrame]:
    """Counts of the latest snapshot, and the figures of the published bundle."""
    model = None
    metrics = bundle.metrics(spark, bundle_folder(out_dir))
    if metrics["method"] is not None:
        model = bundle.load(spark, bundle_folder(out_dir)).model.stages[-1]
    return market.run_report(raw, latest_features(spark, out_dir), metrics, model)


def latest_features(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest ML-ready snapshot written by ``prepare``."""
    return snapshots.load_clean(spark, os.path.join(out_dir, "clean"))
