"""MLlib's boosted trees grown over cells.

The same booster as MLlib's ``GBTRegressor`` and ``GBTClassifier``: the first tree takes
the labels, later ones the loss's gradients; splits by variance, features drawn by node,
rows by tree, pairs of leaves with one prediction merged.  MLlib grows each level of each
tree by a job over the rows; here rows that share all bins are one cell
(``operators/cells``).  The result is MLlib's own model, read from its stored form.

A feature with at most ``maxBins`` values is cut between all of them, as in MLlib; others
at exact quantiles, where MLlib takes them from a sample.  Draws are by hashes of the rows
instead of their places in partitions, so a model does not depend on how rows lie.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from immolens.operators import cells
from immolens.operators.stats import quantile_table
from immolens.session import shared_folder

BINS = 32                   # MLlib's maxBins
SET = {"featuresCol", "labelCol", "maxIter", "stepSize", "maxDepth", "subsamplingRate",
       "featureSubsetStrategy", "seed", "checkpointInterval"}


@dataclass
class Prepared:
    """Binned rows with the labels that were asked for, and their cells."""
    rows: DataFrame
    features: list[str]
    cuts: list[list[float]]
    cells: cells.Cells

    def done(self) -> None:
        self.rows.unpersist()


def prepare(df: DataFrame, features: list[str], labels: list[str], key: str = "id_annonce") -> Prepared | None:
    """Nothing if there are no rows, values or labels are missing (MLlib itself says so then)
    or there are too many cells."""
    x, y = ([F.col(c).cast("double") for c in names] for names in (features, labels))
    blank = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) for v in [*x, *y]])
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"),
                   *[F.approx_count_distinct(v, 0.02).alias(f"x_{i}") for i, v in enumerate(x)]).first()
    if not found["n"] or found["blank"] or not features:
        return None
    few = [i for i in range(len(x)) if found[f"x_{i}"] <= 2 * BINS]
    values = df.agg(*[F.sort_array(F.collect_set(x[i])).alias(f"x_{i}") for i in few]).first() if few else {}
    cuts: dict[int, list[float]] = {i: [(a + b) / 2 for a, b in zip(values[f"x_{i}"], values[f"x_{i}"][1:])]
                                    for i in few if len(values[f"x_{i}"]) <= BINS}
    many = [i for i in range(len(x)) if i not in cuts]
    table = quantile_table(df, [(x[i], None) for i in many], [i / BINS for i in range(1, BINS)])
    cuts |= {i: sorted(set(qs)) for i, qs in zip(many, table, strict=True)}
    own = [cuts[i] for i in range(len(x))]
    rows = cells.binned_rows(df, key if key in df.columns else None, features, own, labels).persist()
    there = cells.cells_of(rows, len(features), labels)
    if there is None:
        rows.unpersist()
        return None
    return Prepared(rows, features, own, there)


def settings(estimator) -> cells.Settings | None:
    """Of a booster of MLlib's; nothing if it asks for what is not done here."""
    get = estimator.getOrDefault
    part = get("featureSubsetStrategy")
    if {p.name for p in estimator._paramMap} - SET or not re.fullmatch(r"all|0?\.\d+|1\.0", part):
        return None
    loss = "first_logistic" if isinstance(estimator, GBTClassifier) else "first_squared"
    return cells.Settings(get("labelCol"), loss, get("maxIter"), get("maxDepth"), get("stepSize"),
                          get("subsamplingRate"), 1.0 if part == "all" else float(part), 0.0, 0.0, get("seed"))


def fit(estimator, prepared: Prepared | None):
    """The fitted model; nothing if MLlib's own fit has to be taken."""
    own = settings(estimator)
    if own is None or prepared is None:
        return None
    width = [len(c) + 1 for c in prepared.cuts]
    trees = cells.grown(prepared.rows, prepared.cells, width, own, 0.0)
    return as_mllib(prepared.rows.sparkSession, estimator, trees, prepared.cuts)


# ---------------------------------------------------------------------- MLlib's stored form
def _metadata(spark: SparkSession, of, name: str, **more) -> str:
    given = [{p.name: v for p, v in params.items()} for params in (of._paramMap, of._defaultParamMap)]
    return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000),
                       "sparkVersion": spark.version, "uid": of.uid, "paramMap": given[0],
                       "defaultParamMap": given[1], **more})


def _in_order(tree: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(node, left, right) of a tree, a parent before its children, numbered in that order;
    leaves have -1.  Two leaves with one prediction become one."""
    feature, value = tree["feature"].copy(), tree["value"]
    for n in np.flatnonzero(feature >= 0)[::-1]:
        a, b = 2 * n + 1, 2 * n + 2
        if feature[a] < 0 and feature[b] < 0 and value[a] == value[b]:
            feature[n] = -1
    out: list[tuple[int, int, int]] = []

    def add(n: int) -> int:
        at = len(out)
        out.append((n, -1, -1))
        if feature[n] >= 0:
            left = add(2 * n + 1)
            out[at] = (n, left, add(2 * n + 2))
        return at
    add(0)
    return out


def _nodes(trees: list[dict[str, np.ndarray]], cuts: list[list[float]]) -> pa.Table:
    parts = []
    for i, tree in enumerate(trees):
        n, left, right = np.array(_in_order(tree), np.int32).T
        inner, count = left >= 0, np.maximum(tree["count"][n], 1.0)
        at = np.array([cuts[f][b] if s else np.nan for f, b, s in zip(tree["feature"][n], tree["bin"][n], inner)])
        stats = np.stack([tree["count"][n], tree["total"][n], tree["squares"][n]], axis=1)
        spread = np.maximum(stats[:, 2] / count - (stats[:, 1] / count) ** 2, 0.0)
        ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
        split = pa.StructArray.from_arrays(
            [pa.array(np.where(inner, tree["feature"][n], -1).astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(at[inner])),
             pa.array(np.full(len(n), -1, np.int32))],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        node = pa.StructArray.from_arrays(
            [pa.array(np.arange(len(n), dtype=np.int32)), pa.array(tree["value"][n]), pa.array(spread),
             pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 3), pa.array(stats.ravel())),
             pa.array(tree["count"][n].astype(np.int64)),
             pa.array(np.where(inner, 2 * tree["gain"][n] / count, -1.0)),
             pa.array(left), pa.array(right), split],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        parts.append(pa.table({"treeID": pa.array(np.full(len(n), i, np.int32)), "nodeData": node}))
    return pa.concat_tables(parts)


def as_mllib(spark: SparkSession, estimator, trees: list[dict[str, np.ndarray]], cuts: list[list[float]]):
    """MLlib's model of the trees: written as its writer does, to the shared folder, and loaded."""
    path = f"{shared_folder(spark)}/immolens/trees-{uuid.uuid4().hex}"
    kind, name = ((GBTClassificationModel, "classification.GBTClassificationModel")
                  if isinstance(estimator, GBTClassifier) else (GBTRegressionModel, "regression.GBTRegressionModel"))
    get = estimator.getOrDefault
    one = DecisionTreeRegressor(featuresCol=get("featuresCol"), labelCol=get("labelCol"),
                                maxDepth=get("maxDepth"), seed=get("seed"))
    single = _metadata(spark, one, "regression.DecisionTreeRegressionModel")
    singles = [(i, single.replace(one.uid, f"{one.uid}_{i}"), 1.0 if i == 0 else float(get("stepSize")))
               for i in range(len(trees))]
    whole = _metadata(spark, estimator, name, numFeatures=len(cuts), numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(singles, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(_nodes(trees, cuts)).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)
