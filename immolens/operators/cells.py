"""Boosted trees over cells: rows that fall into the same bins are one cell.

A tree sees no more of a row than its bins, its label and whether it is drawn.  So
for a model the rows of a cell come down to how many of them are drawn for each tree
and the sum of their labels, and a level of a tree needs no pass over the rows.  Cells
are bounded by the bins, not by the rows; where there are more than ``MOST_CELLS`` of
them, nothing is grown here and the callers go level by level over the rows.

Rows are dealt in equal parts along the order of their cells, so a cell with many rows
is shared by several tasks.  A part hands on its cells' sums, some trees at a time, and
one task a model adds them up and grows the trees in order.  Labels are rounded to a
power of two at which every sum of a cell is exact, so trees do not depend on how rows
are partitioned.  Draws are Spark's own ``xxhash64`` of row, seed and tree.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of it
MOST_CELLS = 1 << 18
PART_ROWS = 1 << 17         # rows of a task that makes sums
TREES = 25                  # whose sums are handed on together
BLOCK_ROWS = 1024           # for which draws are made at once
RECORD_CELLS = 16           # of a record of sums: 10 000 records, one Arrow batch, are about 100 MB
SUMS = "chunk int, cells binary, drawn binary, sums binary, squares binary"
GROWN = ("tree int, feature array<int>, bin array<int>, value array<double>, gain array<double>, "
         "count array<double>, total array<double>, squares array<double>")
FIRST_ORDER = ("first_squared", "first_logistic")       # MLlib's: the others are second-order


@dataclass(frozen=True)
class Settings:
    """Of one model; ``loss`` is ``squared`` or ``logistic`` (labels 0 and 1), or one of
    ``FIRST_ORDER``, whose trees MLlib's weights are not yet in."""
    label: str
    loss: str = "squared"
    trees: int = 200
    depth: int = 7
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    min_gain: float = 0.0
    seed: int = 42


# ---------------------------------------------------------------------- rows
def binned_rows(df: DataFrame, key: str | None, features: list[str], cuts: list[list[float]],
                labels: list[str]) -> DataFrame:
    """(h, labels, b): a hash of key and features, the labels as doubles and the features'
    bins, which are how many cuts lie below a value (a null is in bin 0)."""
    values = [F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(features)]
    hashed = F.xxhash64(*([F.col(key)] if key else []), *[F.col(c).cast("double") for c in features])
    plain = df.select(hashed.alias("h"), *[F.col(c).cast("double").alias(c) for c in labels], *values)
    width = len(features)

    def with_bins(batches):
        for batch in batches:
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width),
                pa.array(cut(batch.columns[1 + len(labels):], cuts).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), *[batch.column(c) for c in labels], lists], ["h", *labels, "b"])
    fields = "".join(f"`{c}` double, " for c in labels)
    return plain.mapInArrow(with_bins, f"h long, {fields}b array<int>")


def cut(values: list[pa.Array], cuts: list[list[float]]) -> np.ndarray:
    """Rows of bins from the columns of values."""
    out = np.zeros((len(values[0]) if values else 0, len(cuts)), np.int32)
    for i, (x, own) in enumerate(zip(values, cuts, strict=True)):
        found = np.searchsorted(np.array(own, np.float64), x.to_numpy(zero_copy_only=False), side="left")
        out[:, i] = np.where(x.is_null().to_numpy(zero_copy_only=False), 0, found)
    return out


def bins_of(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.asarray(batch.column("b").flatten()).reshape(batch.num_rows, n)


def _codes(b: np.ndarray) -> np.ndarray:
    """Rows of bins as texts of bytes, in the order of the bins."""
    return np.ascontiguousarray(b.astype(np.uint8)).view(f"S{b.shape[1]}").ravel()


# ---------------------------------------------------------------------- draws
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= (other := x >> np.uint64(33))
    x *= _P[1]
    x ^= np.right_shift(x, np.uint64(29), out=other)
    x *= _P[2]
    x ^= np.right_shift(x, np.uint64(32), out=other)
    return x


def _hash_long(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    h = (before + (_P[4] + np.uint64(8))) ^ (_turned(value * _P[1], 31) * _P[0])
    return _mixed(_turned(h, 27) * _P[0] + _P[3])


def _hash_int(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    h = (before + (_P[4] + np.uint64(4))) ^ ((value & np.uint64(0xFFFFFFFF)) * _P[0])
    other = h << np.uint64(23)
    h >>= np.uint64(41)
    h |= other
    h *= _P[1]
    h += _P[2]
    return _mixed(h)


def _as_int(value: int) -> int:
    return (value + (1 << 31)) % (1 << 32) - (1 << 31)


def drawn_column(seed: int, share: float, tree: int) -> Column:
    """Whether a row is drawn for a tree, by its column ``h``."""
    found = F.xxhash64("h", F.lit(_as_int(seed)), F.lit(tree))
    return F.shiftrightunsigned(found, 11) < F.lit(math.ceil(share * (1 << 53)))


def drawn(h: np.ndarray, seed: int, share: float, trees: range) -> np.ndarray:
    """``drawn_column`` of rows by trees."""
    one = np.array([_as_int(seed)], np.int64).view(np.uint64)
    base = _hash_int(one, _hash_long(h.view(np.uint64), np.array([42], np.uint64)))
    found = _hash_int(np.arange(trees.start, trees.stop, dtype=np.uint64)[None, :], base[:, None])
    found >>= np.uint64(11)
    return found < np.uint64(math.ceil(share * (1 << 53)))


# ---------------------------------------------------------------------- cells
@dataclass
class Cells:
    """The distinct rows of bins in order, how many rows each has, and by label the step
    to which it is rounded."""
    bins: np.ndarray
    rows: np.ndarray
    steps: dict[str, float]


def cells_of(rows: DataFrame, n: int, labels: list[str]) -> Cells | None:
    """The cells of ``binned_rows``; nothing if there are more than ``MOST_CELLS`` or a
    label is not finite or beyond 1e28."""
    got = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).toArrow()
    if not 0 < got.num_rows <= MOST_CELLS:
        return None
    batch = got.combine_chunks().to_batches()[0]
    b, count = bins_of(batch, n), batch.column("n").to_numpy()
    if b.max(initial=0) > 255:
        return None
    order = np.lexsort(b.T[::-1])
    largest = rows.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in labels]).first()
    steps = {}
    for c in labels:
        most = largest[c] or 0.0
        if not most < 1e28:             # a NaN is the largest of all
            return None
        steps[c] = 2.0 ** (math.ceil(math.log2(most * float(count.max()))) - 52) if most else 1.0
    return Cells(b[order].astype(np.uint8), count[order].astype(np.int64), steps)


def _sums(rows: DataFrame, cells: Cells, own) -> DataFrame:
    """Of a model's rows by cell and tree: how many are drawn, the sums of their labels and,
    for a first-order model, of the labels' squares."""
    label, step, n = own.label, cells.steps[own.label], cells.bins.shape[1]
    codes, size = _codes(cells.bins), cells.rows
    before = np.cumsum(size) - size
    parts = max(1, -(-int(size.sum()) // PART_ROWS))
    trees = own.trees if own.rows < 1.0 else 1          # every row is drawn: once for all trees
    squares = own.loss in FIRST_ORDER

    def dealt(batches):
        for batch in batches:
            y = batch.column(label)
            there = y.is_valid().to_numpy(zero_copy_only=False)
            h = batch.column("h").to_numpy()[there]
            cell = np.searchsorted(codes, _codes(bins_of(batch, n)))[there]
            place = (_hash_long(h.view(np.uint64), np.array([7], np.uint64)) >> np.uint64(11)) / 2.0 ** 53
            at = (before[cell] + place * size[cell]) // PART_ROWS
            yield pa.RecordBatch.from_arrays([
                pa.array(np.minimum(at, parts - 1).astype(np.int32)), pa.array(cell.astype(np.int32)),
                pa.array(h), pa.array(np.rint(y.to_numpy(zero_copy_only=False)[there] / step) * step)],
                ["part", "cell", "h", "y"])

    def summed(batches):
        held = [[batch.column(c).to_numpy() for c in ("cell", "h", "y")] for batch in batches]
        if not held:
            return
        cell, h, y = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cell, kind="stable")
        cell, h, y = cell[order], h[order], y[order]
        for low in range(0, len(cell), BLOCK_ROWS):
            one = slice(low, low + BLOCK_ROWS)
            first = np.flatnonzero(np.diff(cell[one], prepend=-1))
            mine = cell[one][first]
            for chunk in range(0, trees, TREES):
                wanted = range(chunk, min(trees, chunk + TREES))
                d = (drawn(h[one], own.seed, own.rows, wanted) if own.rows < 1.0
                     else np.ones((len(h[one]), 1), bool)).astype(np.float64)
                count = np.add.reduceat(d, first).astype(np.int32)
                d *= y[one, None]
                total = np.add.reduceat(d, first)
                square = np.add.reduceat(d * y[one, None], first) if squares else total[:, :0]
                cuts = range(0, len(mine), RECORD_CELLS)
                columns = [[x[i:i + RECORD_CELLS].tobytes() for i in cuts]
                           for x in (mine.astype(np.int32), count, total, square)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk // TREES] * len(cuts), pa.int32()),
                     *[pa.array(x, pa.binary()) for x in columns]],
                    ["chunk", "cells", "drawn", "sums", "squares"])
    return (rows.select("h", label, "b").mapInArrow(dealt, "part int, cell int, h long, y double")
            .repartitionById(parts, "part").mapInArrow(summed, SUMS))


# ---------------------------------------------------------------------- trees
class Growth:
    """A model's trees over cells, one after the other."""

    def __init__(self, own, cells: Cells, width: list[int], base: float):
        self.own, self.width, self.bins = own, width, np.ascontiguousarray(cells.bins.T).astype(np.int64)
        self.first_order = own.loss in FIRST_ORDER
        self.l2 = 0.0 if self.first_order else own.l2
        self.margin = np.full(len(cells.bins), base)

    def gradients(self, tree: int, n: np.ndarray, s: np.ndarray, q: np.ndarray | None):
        """(G, H, squares) of each cell from its rows' number, sum of labels and of squares."""
        m = self.margin
        if self.own.loss == "squared":
            return m * n - s, n, None
        if self.own.loss == "logistic":
            p = 1.0 / (1.0 + np.exp(-m))
            return n * p - s, n * p * (1.0 - p), None
        if self.own.loss == "first_squared":            # MLlib: labels first, then twice the rest
            return (-s, n, q) if tree == 0 else (2 * (m * n - s), n, 4 * (q - 2 * m * s + m * m * n))
        up, down = (1.0, -1.0) if tree == 0 else (4 / (1 + np.exp(2 * m)), -4 / (1 + np.exp(-2 * m)))
        return -(s * up + (n - s) * down), n, s * up ** 2 + (n - s) * down ** 2

    def allowed(self, tree: int):
        """Which features nodes may split on, level by level: a draw by tree, for MLlib's by node."""
        own, n = self.own, len(self.width)
        most = max(1, math.ceil(own.columns * n))
        if most == n or not self.first_order:
            same = np.isin(np.arange(n), random.Random(own.seed * 1_000_003 + tree).sample(range(n), most))
            return lambda k: np.tile(same, (k, 1))
        draws = np.random.default_rng([own.seed % (1 << 63), tree])
        return lambda k: np.argsort(np.argsort(draws.random((k, n)), axis=1), axis=1) < most

    def grow(self, tree: int, n: np.ndarray, s: np.ndarray, q: np.ndarray | None) -> dict[str, np.ndarray]:
        """The next tree; ties go to the first feature and bin, as in ``boosting._split``."""
        own, l2 = self.own, self.l2
        g, h, squares = self.gradients(tree, n, s, q)
        size = (1 << own.depth + 1) - 1
        out = {"feature": np.full(size, -1, np.int32), "bin": np.zeros(size, np.int32),
               **{c: np.zeros(size) for c in ("value", "gain", "count", "total", "squares")}}
        step = np.zeros(len(g))
        allowed, nodes, every = self.allowed(tree), np.zeros(1, np.int64), np.arange(len(g))
        place = np.zeros(len(g), np.int64)      # a cell's node of this level; in a leaf, one beyond them
        for level in range(own.depth + 1):
            k = len(nodes)
            total, weight = (np.bincount(place, x, k + 1)[:k] for x in (g, h))
            value = -total / np.maximum(weight + l2, 1e-300)
            value = value if self.first_order else own.rate * value
            out["value"][nodes], out["count"][nodes], out["total"][nodes] = value, weight, -total
            if squares is not None:
                out["squares"][nodes] = np.bincount(place, squares, k + 1)[:k]
            best, feature, at = np.full(k, own.min_gain), np.full(k, -1), np.zeros(k, np.int64)
            if level < own.depth:
                may = allowed(k)
                asked = [f for f, w in enumerate(self.width) if w > 1 and may[:, f].any()]
                ends = np.cumsum([0] + [self.width[f] - 1 for f in asked])
                a, b = np.empty((2, k, ends[-1]))
                of = {w: place * w for w in {self.width[f] for f in asked}}
                for f, low, high in zip(asked, ends, ends[1:]):
                    w = self.width[f]
                    index = of[w] + self.bins[f]
                    for to, x in ((a, g), (b, h)):
                        sums = np.bincount(index, x, (k + 1) * w)[:k * w].reshape(k, w)
                        np.cumsum(sums[:, :-1], axis=1, out=to[:, low:high])
                c, d = total[:, None] - a, weight[:, None] - b
                least = np.maximum(1e-9, 1e-12 * weight)[:, None]
                both = (b > least) & (d > least)
                gain = 0.5 * (a * a / np.where(both, b + l2, 1.0) + c * c / np.where(both, d + l2, 1.0)
                              - (total ** 2 / np.maximum(weight + l2, 1e-300))[:, None])
                gain[~both] = -np.inf
                rows = np.arange(k)
                for f, low, high in zip(asked, ends, ends[1:]):
                    j = np.argmax(gain[:, low:high], axis=1)
                    top = gain[rows, low + j]
                    better = may[:, f] & (top > best + 1e-9 * np.abs(best))
                    best, feature, at = (np.where(better, x, y) for x, y in ((top, best), (f, feature), (j, at)))
            split = feature >= 0
            out["feature"][nodes], out["bin"][nodes] = feature, at
            out["gain"][nodes] = np.where(split, best, 0.0)
            step += np.append(np.where(split, 0.0, value), 0.0)[place]
            if not split.any():
                break
            right = self.bins[np.append(feature, 0)[place], every] > np.append(at, 0)[place]
            first = np.append(np.where(split, 2 * (np.cumsum(split) - 1), 2 * split.sum()), 2 * split.sum())
            place = np.minimum(first[place] + right, 2 * split.sum())
            nodes = np.stack([2 * nodes[split] + 1, 2 * nodes[split] + 2], axis=1).ravel()
        self.margin = self.margin + (own.rate if self.first_order and tree else 1.0) * step
        return out


def grown(rows: DataFrame, cells: Cells, width: list[int], own, base: float) -> list[dict[str, np.ndarray]]:
    """All trees of a model, in order; nodes as in ``Boosted``, of first-order models with
    values that are not yet weighted."""
    once = own.rows >= 1.0

    def chunks(batches) -> Iterator[tuple[int, list[np.ndarray]]]:
        at, held = None, []
        for batch in batches:
            for chunk, *parts in zip(*[batch.column(c).to_pylist() for c in
                                       ("chunk", "cells", "drawn", "sums", "squares")], strict=True):
                if chunk != at:
                    if at is not None:
                        yield at, held
                    trees = 1 if once else min(TREES, own.trees - chunk * TREES)
                    at, held = chunk, [np.zeros((len(cells.bins), trees)) for _ in range(3)]
                cell, count, *sums = (np.frombuffer(x, t) for x, t in
                                      zip(parts, (np.int32, np.int32, np.float64, np.float64), strict=True))
                for to, x in zip(held, (count, *sums), strict=True):
                    if len(x):
                        to[cell] += x.reshape(len(cell), -1)
        if at is not None:
            yield at, held

    def grow(batches):
        growth = Growth(own, cells, width, base)
        for chunk, held in chunks(batches):
            for tree in range(own.trees) if once else range(chunk * TREES, min(own.trees, (chunk + 1) * TREES)):
                sums = [np.ascontiguousarray(x[:, 0 if once else tree - chunk * TREES]) for x in held]
                found = growth.grow(tree, *sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int32()), *[pa.array([x]) for x in found.values()]],
                    ["tree", *found])
    got = (_sums(rows, cells, own).repartition(1).sortWithinPartitions("chunk")
           .mapInArrow(grow, GROWN).toArrow().sort_by("tree"))
    names = got.column_names[1:]
    return [dict(zip(names, (np.asarray(x) for x in nodes), strict=True)) for nodes in
            zip(*[[v.values.to_numpy() for v in got.column(c)] for c in names], strict=True)]
