"""Second-order gradient boosting on binned features.

Features are cut into bins at exact quantiles once.  Rows that share all bins are one
cell, and trees are grown over cells (``operators/cells``), whose number the bins
bound.  With more cells than that module holds, a level of a tree is one grouped
aggregate over the rows: the sums of gradients and Hessians by (model, node, feature,
bin), combined map-side, whatever the number of rows.  At most models x nodes x
features x bins sums come to the driver then, which takes the best split of each node
from them; rows never do.  Several models that share rows and features (price,
log price, above the median) grow side by side.

Sums are exact, so a tree does not depend on how rows are partitioned.  Rows and
columns of a tree are drawn by a hash of the seed.  Leaves are shrunk by
``l2`` and the learning rate; the gain of every split is kept, and its shares are
the features' importance (M14).
"""

from __future__ import annotations

import json
import math
import random
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from immolens.functions.numeric import exact
from immolens.operators import cells
from immolens.operators.cells import Settings
from immolens.operators.models import together
from immolens.operators.stats import quantile_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of it
BINS = 32
CUT_EVERY = 2               # trees after which the rows' predictions are written
HELD_ROWS = 1 << 18         # rows that a task predicts at once
NODES = "array<struct<feature:int,bin:int,value:double>>"
Store = Callable[[str, Callable[[], DataFrame]], DataFrame]


@dataclass
class Boosted:
    """A fitted model.  A tree is a list of nodes (feature, bin, value): the children of
    node n are 2n + 1 and 2n + 2, a leaf has feature -1; ``gains`` are by feature."""
    settings: Settings
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        """The sum of all trees over the model's features."""
        return _margin(F.lit(self.base), self.trees, binned(self.features, self.cuts))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the prediction: a value, or 0 / 1 by a probability above a half.

        Tasks go through the trees once for all rows at hand that share their bins."""
        kept = [c for c in df.columns if c != name]
        shown = [F.col(c).cast("double").alias(f"_x_{i}") for i, c in enumerate(self.features)]
        own, sign = self, self.settings.loss == "logistic"

        def predicted(batches):
            held, rows = [], 0
            for batch in batches:
                held, rows = [*held, batch], rows + batch.num_rows
                if rows >= HELD_ROWS:
                    yield from own._predicted(held, len(kept), name, sign)
                    held, rows = [], 0
            yield from own._predicted(held, len(kept), name, sign)
        schema = StructType([*df.select(*kept).schema.fields, StructField(name, DoubleType())])
        return df.select(*kept, *shown).mapInArrow(predicted, schema)

    def _predicted(self, held: list[pa.RecordBatch], kept: int, name: str, sign: bool):
        if not held:
            return
        b = np.concatenate([cells.cut(batch.columns[kept:], self.cuts) for batch in held])
        different, place = np.unique(b, axis=0, return_inverse=True)
        found = _raised(np.full(len(different), self.base), different, self.trees)[place.ravel()]
        found, at = (found > 0).astype(np.float64) if sign else found, 0
        for batch in held:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(found[at:at + batch.num_rows])],
                [*batch.schema.names[:kept], name])
            at += batch.num_rows

    def importance(self, spark) -> DataFrame:
        """(feature, weight): the gain of each feature's splits."""
        return spark.createDataFrame(list(zip(self.features, map(float, self.gains), strict=True)),
                                     "feature string, weight double")

    def to_json(self) -> str:
        return json.dumps({**vars(self), "settings": vars(self.settings)})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        own = json.loads(text)
        return cls(**{**own, "settings": Settings(**own["settings"])})


# ---------------------------------------------------------------------- bins
def bin_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Distinct quantiles of each feature, all from one aggregate."""
    probs = [i / bins for i in range(1, bins)]
    table = quantile_table(df, [(F.col(c).cast("double"), None) for c in features], probs)
    return [sorted({float(q) for q in qs if q is not None}) for qs in table]


def binned(features: list[str], cuts: list[list[float]]) -> Column:
    """The features' bins: how many cuts lie below a value (a null is in bin 0)."""
    def one(name, own):
        if not own:
            return F.lit(0)
        below = F.array_size(F.filter(F.array(*map(F.lit, own)),
                                      lambda c: c < F.col(name).cast("double")))
        return F.coalesce(below, F.lit(0))
    return F.array(*[one(n, c) for n, c in zip(features, cuts, strict=True)])


def _margin(start: Column, trees: list, bins: Column) -> Column:
    """``start`` plus the value of the leaf that each tree leads to."""
    if not trees:
        return start
    as_text = json.dumps([[{"feature": f, "bin": b, "value": v} for f, b, v in t] for t in trees])
    depth = max(len(t) for t in trees).bit_length()
    steps = F.sequence(F.lit(1), F.lit(depth))

    def leaf(tree):
        def down(n, _):
            node = F.get(tree, n)
            child = n * 2 + F.when(F.get(bins, node["feature"]) <= node["bin"], 1).otherwise(2)
            return F.when(node["feature"] >= 0, child).otherwise(n).cast("int")
        return F.get(tree, F.aggregate(steps, F.lit(0), down))["value"]
    return F.aggregate(F.from_json(F.lit(as_text), f"array<{NODES}>"), start,
                       lambda total, tree: total + leaf(tree))


# ---------------------------------------------------------------------- trees
def _drawn(own: Settings, tree: int) -> Column:
    """Whether a row is drawn for a tree."""
    return cells.drawn_column(own.seed, own.rows, tree) if own.rows < 1.0 else F.lit(True)


def _columns(own: Settings, tree: int, n: int) -> set[int]:
    return set(random.Random(own.seed * 1_000_003 + tree).sample(range(n), max(1, math.ceil(
        own.columns * n))))


PART = float(1 << 32)       # a sum of decimals is kept as a high and a low whole number
SUMS = "model int, node int, feature int, bin int, g_high double, g_low double, h_high double, h_low double"


def _leaves(b: np.ndarray, nodes: list[tuple[int, int, float]]) -> np.ndarray:
    """The node of a tree that each row of bins comes to."""
    feature, cut = (np.array([x[k] for x in nodes], np.int64) for k in (0, 1))
    at, every = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(len(nodes).bit_length()):
        f = feature[at]
        left = b[every, np.maximum(f, 0)] <= cut[at]
        at = np.where(f >= 0, 2 * at + np.where(left, 1, 2), at)
    return at


def _raised(margin: np.ndarray, b: np.ndarray, trees: list) -> np.ndarray:
    for nodes in trees:
        margin = margin + np.array([v for _, _, v in nodes])[_leaves(b, nodes)]
    return margin


def _with_margins(rows: DataFrame, trees: dict[str, list], n: int) -> DataFrame:
    """The rows with their margins after further trees of each model."""
    schema = rows.schema

    def raised(batches):
        for batch in batches:
            b = cells.bins_of(batch, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(_raised(batch.column(c).to_numpy(), b, trees[c[2:]])) if c[2:] in trees
                and c.startswith("m_") else batch.column(c) for c in schema.names], schema.names)
    return rows.mapInArrow(raised, schema)


def _exact_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as whole ten-billionths, high and low part; what no decimal holds is 0."""
    held = np.where(np.abs(x) < 1e28, x, 0.0)
    whole = np.rint(held.astype(np.longdouble) * 10 ** 10)
    high = np.floor(whole / PART)
    return high.astype(np.float64), (whole - high * PART).astype(np.float64)


def _sums(rows: DataFrame, growing: dict[str, tuple[Settings, Column, list, set[int]]],
          since: dict[str, list], width: list[int]) -> dict:
    """{(model, node): (G, H) by feature and bin} of the rows in open nodes; ``growing`` has
    a model's settings, whether a row is drawn, its tree and the tree's open nodes, ``since``
    the trees that the rows' margins lack.

    A task adds up its rows by node and bin in arrays; what comes out of it is at most
    models x nodes x features x bins rows, whatever the number of rows."""
    names, plain = list(growing), []
    columns = ["b"]
    for i, (own, drawn, nodes, open_) in enumerate(growing.values()):
        columns += [drawn.alias(f"drawn_{i}"), F.col(own.label).cast("double").alias(f"y_{i}"),
                    F.col(f"m_{names[i]}").alias(f"m_{i}")]
        padded = nodes + [(-1, 0, 0.0)] * (max(open_) + 1 - len(nodes))
        plain.append((own.loss, padded, np.isin(np.arange(len(padded)), list(open_)), since[names[i]]))
    start = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    feature, bins = np.repeat(np.arange(len(width)), width), int(start[-1])

    def added(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            every = cells.bins_of(batch, len(width)).astype(np.int64)
            for i, (loss, tree, wanted, trees) in enumerate(plain):
                drawn = batch.column(f"drawn_{i}").to_numpy(zero_copy_only=False).astype(bool)
                at = _leaves(every, tree)
                mine = np.flatnonzero(drawn & wanted[at])
                if not len(mine):
                    continue
                b = every[mine]
                y = batch.column(f"y_{i}").to_numpy(zero_copy_only=False)[mine]
                margin = _raised(batch.column(f"m_{i}").to_numpy()[mine], b, trees)
                if loss == "squared":
                    g, h = margin - y, np.ones(len(mine))
                else:
                    p = 1.0 / (1.0 + np.exp(-margin))
                    g, h = p - y, p * (1.0 - p)
                nodes, place = np.unique(at[mine], return_inverse=True)
                index, size = (place[:, None] * bins + b + start[:-1]).ravel(), len(nodes) * bins
                new = np.stack([np.bincount(index, minlength=size).astype(np.float64),
                                *[np.bincount(index, np.repeat(x, len(width)), size)
                                  for v in (g, h) for x in _exact_parts(v)]])
                for k, n in enumerate(nodes):
                    part = new[:, k * bins:(k + 1) * bins] + sums.get((i, int(n)), 0.0)
                    for low in (2, 4):          # the low part stays below a whole high one
                        carry = np.floor(part[low] / PART)
                        part[low - 1] += carry
                        part[low] -= carry * PART
                    sums[i, int(n)] = part
        for (i, n), own in sums.items():
            there = np.flatnonzero(own[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(there), i, np.int32)), pa.array(np.full(len(there), n, np.int32)),
                pa.array(feature[there].astype(np.int32)),
                pa.array((there - start[feature[there]]).astype(np.int32)),
                *[pa.array(x[there]) for x in own[1:]]],
                ["model", "node", "feature", "bin", "g_high", "g_low", "h_high", "h_low"])

    sums = ["g_high", "g_low", "h_high", "h_low"]
    got = (rows.select(*columns).mapInArrow(added, SUMS).groupBy("model", "node", "feature", "bin")
           .agg(*[F.sum(c).alias(c) for c in sums]).toArrow().to_pydict())
    out: dict = {}
    for m, n, f, b, *parts in zip(*(got[c] for c in ("model", "node", "feature", "bin", *sums)), strict=True):
        g, h = (float(Fraction(int(parts[k]) * int(PART) + int(parts[k + 1]), 10 ** 10)) for k in (0, 2))
        out.setdefault((names[m], n), []).append((f, b, g, h))
    return out


def _split(own: Settings, sums: list[tuple], width: list[int], allowed: set[int]):
    """(feature, bin, gain, value): the best split of a node (feature -1: none) and the
    value it has as a leaf; ties go to the first feature and bin."""
    total, best = None, (-1, 0, own.min_gain)
    by: dict[int, np.ndarray] = {}
    for f, b, g, h in sums:
        by.setdefault(f, np.zeros((2, width[f])))[:, b] = g, h
    for f in sorted(by):
        g, h = np.cumsum(by[f], axis=1)
        if total is None:
            total = g[-1], h[-1]
        if f not in allowed or len(g) < 2:
            continue
        left, right = (g[:-1], h[:-1]), (g[-1] - g[:-1], h[-1] - h[:-1])
        both = (left[1] > 1e-9) & (right[1] > 1e-9)
        gain = 0.5 * (left[0] ** 2 / (left[1] + own.l2) + right[0] ** 2 / (right[1] + own.l2)
                      - g[-1] ** 2 / (h[-1] + own.l2))
        gain = np.where(both, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best[2] + 1e-9 * abs(best[2]):
            best = f, at, float(gain[at])
    return (*best, float(-own.rate * total[0] / (total[1] + own.l2)))


def fit(df: DataFrame, features: list[str], models: dict[str, Settings], key: str, store: Store,
        bins: int = BINS) -> dict[str, Boosted]:
    """Grow the models side by side.  ``store(name, make)`` writes a table and reads it
    back: the binned rows once, and their predictions every ``CUT_EVERY`` trees where
    there are too many cells.

    A row counts once, with the label that it has; rows without a label are left out of
    that model.  No rows, or no labels: a model without trees."""
    cuts = bin_cuts(df, features, bins)
    width = [len(c) + 1 for c in cuts]
    labels = sorted({s.label for s in models.values()})
    rows = store("boosting-rows", lambda: cells.binned_rows(df, key, features, cuts, labels))
    means = rows.agg(*[F.avg(exact(c)).cast("double").alias(c) for c in labels]).first().asDict()
    out = {}
    for name, own in models.items():
        mean = means[own.label]
        base = 0.0 if mean is None else mean if own.loss == "squared" else math.log(
            max(mean, 1e-6) / max(1 - mean, 1e-6))
        out[name] = Boosted(own, list(features), cuts, base, [], [0.0] * len(features))
    found = cells.cells_of(rows, len(features), labels)
    if found is None:
        _grow_by_level(rows, width, out, store)
        return out
    growing = [m for m in out.values() if means[m.settings.label] is not None]
    for m, trees in zip(growing, together(df.sparkSession, *[
            lambda m=m: cells.grown(rows, found, width, m.settings, m.base) for m in growing]), strict=True):
        for tree in trees:
            leaf = tree["feature"] < 0
            m.trees.append(list(zip(tree["feature"].tolist(), tree["bin"].tolist(),
                                    np.where(leaf, tree["value"], 0.0).tolist(), strict=True)))
            for f, gain in zip(tree["feature"][~leaf].tolist(), tree["gain"][~leaf].tolist(), strict=True):
                m.gains[f] += gain
    return out


def _grow_by_level(rows: DataFrame, width: list[int], out: dict[str, Boosted], store: Store) -> None:
    """Add the trees of all models, each level by one aggregate over the rows."""
    models, n_features = {n: m.settings for n, m in out.items()}, len(width)
    labelled = rows.agg(*[F.count(s.label).alias(n) for n, s in models.items()]).first().asDict()
    rows = rows.withColumns({f"m_{n}": F.lit(m.base) for n, m in out.items()})
    since: dict[str, list] = {n: [] for n in models}
    for tree in range(max(s.trees for s in models.values())):
        grown: dict[str, list] = {n: [(-1, 0, 0.0)] for n, s in models.items()
                                  if tree < s.trees and labelled[n]}
        open_ = {n: {0} for n in grown}
        for level in range(max((models[n].depth for n in grown), default=0) + 1):
            growing = {}
            for n in grown:
                if not open_[n]:
                    continue
                drawn = _drawn(models[n], tree) & F.col(models[n].label).isNotNull()
                growing[n] = (models[n], drawn, grown[n], open_[n])
            if not growing:
                break
            found = _sums(rows, growing, since, width)
            for n in growing:
                own, nodes, after = models[n], grown[n], set()
                nodes.extend([(-1, 0, 0.0)] * ((1 << level + 1) - 1 - len(nodes)))
                allowed = _columns(own, tree, n_features) if level < own.depth else set()
                for at in sorted(open_[n]):
                    if (n, at) not in found:
                        continue
                    f, b, gain, value = _split(own, found[n, at], width, allowed)
                    nodes[at] = (f, b, 0.0 if f >= 0 else value)
                    if f >= 0:
                        out[n].gains[f] += gain
                        after |= {2 * at + 1, 2 * at + 2}
                open_[n] = after
        for n, nodes in grown.items():
            out[n].trees.append(nodes)
            since[n].append(nodes)
        if (tree + 1) % CUT_EVERY == 0:
            rows = store(f"boosting-{tree}", lambda rows=rows, since=since: _with_margins(
                rows, since, n_features))
            since = {n: [] for n in models}


# ---------------------------------------------------------------------- models
def price_settings() -> dict[str, Settings]:
    """M9, M10, M12 with their fixed settings."""
    return {"regression_raw": Settings("prix", trees=200),
            "regression_log": Settings("prix_log", trees=300),
            "classification": Settings("label", "logistic", trees=200, depth=6, rows=1.0,
                                       columns=1.0)}


def train_prices(df: DataFrame, store: Store, settings: dict[str, Settings] | None = None,
                 key: str = "id_annonce", bins: int = BINS) -> dict:
    """M9-M12 on the rows and features of ``models.train_models``, with its split,
    metrics and champion, in the same form."""
    from immolens.operators import models

    columns = models.feature_columns(df)
    labelled, median = models.median_label(df)
    train, test = models.split(labelled, key)
    own = fit(train, columns, settings or price_settings(), key, store, bins)

    def regression(name, label, use_log):
        found = models.regression_metrics(own[name].predict(test), label, use_log=use_log)
        return {"model": own[name], **found.first().asDict()}

    out = {"feature_columns": columns, "regression_raw": regression("regression_raw", "prix", False),
           "regression_log": regression("regression_log", "prix_log", True)}
    best, method = (("regression_raw", "prix_brut") if out["regression_raw"]["r2"]
                    > out["regression_log"]["r2"] else ("regression_log", "log_prix"))
    found = models.classification_metrics(own["classification"].predict(test)).first().asDict()
    return {**out, "champion": {**out[best], "method": method},
            "classification": {"model": own["classification"], "median": median, **found}}


def splits(spark, model: Boosted) -> DataFrame:
    """(tree, node, feature, cut, value) of a model: rows up to the cut go to the node's
    first child; a leaf has a value instead."""
    rows = [(i, n, model.features[f] if f >= 0 else None, model.cuts[f][b] if f >= 0 else None,
             None if f >= 0 else v)
            for i, tree in enumerate(model.trees) for n, (f, b, v) in enumerate(tree)
            if f >= 0 or n == 0 or tree[(n - 1) // 2][0] >= 0]
    return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, value double")
