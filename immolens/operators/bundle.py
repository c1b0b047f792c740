"""The stored model bundle (S13-S16) and scoring from it.

Everything that scoring needs is one unit: the city encoding, the cluster
centres, the champion with its assembler as a ``PipelineModel``, and beside
them the feature order, the type flags, the method, the test metrics, the
input ranges and the encoding of unknown cities.  A version is written to
folders of its own and published by one log row (``sources/manifest``), so a
reader never meets the encoding of one training and the model of another.
A session that has nothing but the folder can score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from immolens.functions.numeric import exact_avg
from immolens.operators import scoring
from immolens.operators.models import Clusters
from immolens.sources import manifest, snapshots

METRICS = ("mae", "rmse", "r2")


@dataclass
class Bundle:
    """What scoring needs, as loaded; ``version`` 0 was never stored."""
    encoding: DataFrame
    clusters: Clusters | None
    model: PipelineModel
    features: list[str]
    method: str
    metrics: dict = field(default_factory=dict)
    ranges: dict | None = None
    default_encoding: float | None = None
    version: int = 0

    @property
    def flags(self) -> list[str]:
        return [c for c in self.features if c.startswith(scoring.FLAG)]


def of_training(results: dict, encoding: DataFrame, clusters: Clusters | None,
                ranges: dict | None = None) -> Bundle:
    """The bundle of a training's champion (``models.train_models``)."""
    champion, columns = results["champion"], results["feature_columns"]
    model = PipelineModel([VectorAssembler(inputCols=columns, outputCol="features"),
                           champion["model"]])
    return Bundle(encoding, clusters, model, list(columns), champion["method"],
                  {m: champion.get(m) for m in METRICS}, ranges,
                  encoding.agg(exact_avg("encoding")).first()[0])


def save(spark: SparkSession, root: str, bundle: Bundle) -> int:
    """Write all parts, then publish them; returns the version."""
    folder = manifest.new_folder(root)
    snapshots.save_encoding(bundle.encoding, f"{folder}/encoding")
    snapshots.save_model(bundle.model, f"{folder}/model")
    clusters = bundle.clusters
    return manifest.publish(spark, root, {
        "folder": folder, "features": bundle.features, "method": bundle.method,
        "metrics": bundle.metrics, "ranges": bundle.ranges,
        "default_encoding": bundle.default_encoding,
        "clusters": {"columns": clusters.columns, "centres": clusters.centres}
        if clusters else None})


def load(spark: SparkSession, root: str, version: int | None = None) -> Bundle:
    """The newest (or the given) version, from the folder alone."""
    own = manifest.current(spark, root, version)
    if own is None:
        raise FileNotFoundError(f"no model bundle {version or ''} in {root}")
    clusters = own["clusters"]
    return Bundle(snapshots.load_encoding(spark, f"{own['folder']}/encoding"),
                  Clusters(clusters["columns"], clusters["centres"]) if clusters else None,
                  snapshots.load_pipeline_model(f"{own['folder']}/model"), own["features"],
                  own["method"], own["metrics"], own["ranges"], own["default_encoding"],
                  own["version"])


def metrics(spark: SparkSession, root: str) -> dict:
    """The published metrics, or nulls when nothing was trained yet."""
    own = manifest.current(spark, root)
    found = {**own["metrics"], "method": own["method"]} if own else {}
    return {k: found.get(k) for k in (*METRICS, "method")}


def score(requests: DataFrame, bundle: Bundle) -> DataFrame:
    """M16 with everything from the bundle."""
    return scoring.score(requests, bundle.encoding, bundle.clusters, bundle.model,
                         bundle.features, bundle.method, bundle.metrics.get("r2"),
                         bundle.default_encoding, bundle.ranges)
